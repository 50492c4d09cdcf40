"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import uuid
import warnings

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder in the warehouse where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset: intermediate tables go to the warehouse, which must be shared", stacklevel=2)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` and return the written table: plans that follow stay small
    and lost executors cost nothing.  The files go when the driver ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexbind/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)
