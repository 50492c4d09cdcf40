"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import math
import uuid
import warnings
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"
#: A word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one
    in the warehouse where that is unset (tests, local mode)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        warnings.warn("spark.checkpoint.dir is unset: intermediate tables go to the warehouse, which must be shared", stacklevel=2)
    return (base or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints").rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    This cuts the lineage and survives lost executors.  The files go when the
    driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexbind/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`stored` once it is not needed."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


#: A key with this share of a side's rows is hot; at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 256
#: A key of at most so many rows is never hot.
HOT_ROWS = 1000
#: Parts that a hot key's rows are dealt to.
HOT_PARTS = 32


def hot_safe_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", count: str | None = None, of: DataFrame | None = None) -> DataFrame:
    """``left`` joined on ``key`` with ``right``, which has a row a key at most.

    Rows of ``left`` whose key is hot are dealt to HOT_PARTS parts, and the key's
    row of ``right`` is copied to them.  ``count`` names a column of ``right``
    with the key's rows in ``left``, which saves counting them; ``of`` is a table
    with ``left``'s rows by key that is cheaper to count.  The hot keys are
    1 / HOT_SHARE at most, and only they reach the driver.
    """
    of = left if of is None else of
    if count:
        counted = right.select(F.col(key).alias("_hot"), F.col(count).alias("_n"))
    else:
        counted = of.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n"))
    most = counted.where(F.col("_n") > HOT_ROWS).orderBy(F.desc("_n")).limit(math.ceil(1 / HOT_SHARE)).collect()
    total = ((counted.agg(F.sum("_n")).first()[0] or 0) if count else of.count()) if most else 0
    hot = [k for k, n in most if k is not None and n > total * HOT_SHARE]
    if not hot:
        return left.join(right, key, how)
    part = F.when(F.col(key).isin(hot), F.pmod(F.xxhash64(*left.columns), F.lit(HOT_PARTS))).otherwise(0)
    parts = F.when(F.col(key).isin(hot), F.sequence(F.lit(0).cast("long"), F.lit(HOT_PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.withColumn("_part", part).join(right.withColumn("_part", F.explode(parts)), [key, "_part"], how).drop("_part")


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark's cleaner remove shuffle files that no frame can read again:
    it follows the driver's garbage collection, which is otherwise rare."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes a job's shuffle files as soon as the job has ended, not
    when the driver's collector finds that no frame can read them."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Arrow batches of few rows: whole texts are long, and a batch is held in
    memory on both sides of the Python boundary."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def release_memory() -> None:
    """Give a worker's free memory back at the end of a task: workers live on
    beside the JVM, and allocators keep what they once held."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def kept_name(column: str, own: list[str]) -> str:
    """Name of a kept input column beside an operator's own columns."""
    while column in own:
        column = f"input_{column}"
    return column


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column over all rows."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def blocks_for(total_bytes: int, block_bytes: int) -> int:
    """How many blocks of about ``block_bytes`` hold ``total_bytes``."""
    return max(1, math.ceil(total_bytes / block_bytes))


def fold_of(column: str = "doc_id"):
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(column).cast("string"))
