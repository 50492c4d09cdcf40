"""Views of the standard tables as the engine's inputs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from lexbind.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def printed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id long, line_idx, text, pct): each document's lines, with one space
    between words, and a derived confidence in percent."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line"))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    rows = rows.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), F.array_join(words, " ").alias("text")).where("text <> ''")
    return rows.select(F.col("doc_id").alias("obs_id"), "line_idx", "text", ((F.col("doc_id") * 31 + F.col("line_idx") * 17) % 41 + 60).alias("pct"))


def benchmark_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, key): long titles."""
    return table(spark, sf_dir, "benchmark").select("item_id", T.key("text").alias("key"))


def benchmark_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A catalog of products named by the benchmark items."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.array_join(words, " ").alias("name"))
    null = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    return rows.select(
        F.lit(1).alias("schema_version"), "id", "name", null.alias("producer"), null.alias("region"), none.alias("style"), null.alias("color"), none.alias("grapes"),
        F.lit(None).cast("int").alias("year"), F.lit(None).cast("double").alias("alcohol_percent"), null.alias("slug"), null.alias("image_url"),
        F.array().cast("array<struct<text:string,key:string,source:string>>").alias("aliases"), null.alias("search_text"), null.alias("source"),
    )


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as products: name, brand as producer, type as style."""
    null = F.lit(None).cast("string")
    none = F.array().cast("array<string>")
    return table(spark, sf_dir, "part").select(
        F.lit(1).alias("schema_version"), F.col("p_partkey").cast("string").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("producer"), null.alias("region"),
        F.array("p_type").alias("style"), null.alias("color"), none.alias("grapes"), (F.lit(1990) + F.col("p_size")).alias("year"), F.lit(None).cast("double").alias("alcohol_percent"),
        null.alias("slug"), null.alias("image_url"), F.array().cast("array<struct<text:string,key:string,source:string>>").alias("aliases"), null.alias("search_text"), null.alias("source"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, box_id, r, image_w, image_h): rectangles by integer arithmetic on orders' lines."""
    l = table(spark, sf_dir, "lineitem")
    x1 = (F.col("l_partkey") * 7 + F.col("l_linenumber") * 45) % 400
    y1 = (F.col("l_suppkey") * 3 + F.col("l_orderkey") % 5) % 60
    w, h = (F.col("l_quantity").cast("long") * 3 + 4) % 130 + 4, F.col("l_partkey") % 22 + 4
    rows = l.select(F.col("l_orderkey").alias("obs_id"), F.col("l_linenumber").alias("box_id"), x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + h).alias("y2"))
    r = F.struct(*[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    return rows.select("obs_id", "box_id", r.alias("r"), F.lit(500).alias("image_w"), F.lit(100).alias("image_h"))


@F.arrow_udf(ArrayType(DoubleType()))
def derived_conf(start: pa.Array, modulus: pa.Array, n: pa.Array) -> pa.Array:
    """(100 - (start + 7 i) % modulus) / 100 for i from 1 to n; missing without a start."""
    sizes = n.fill_null(0).to_numpy().astype(np.int64)
    ends = np.cumsum(sizes)
    i = np.arange(1, int(sizes.sum()) + 1) - np.repeat(ends - sizes, sizes)
    rest = np.fmod(np.repeat(start.fill_null(0).to_numpy(), sizes) + 7 * i, np.repeat(modulus.fill_null(1).to_numpy(), sizes))
    lost = np.repeat(start.is_null().to_numpy(zero_copy_only=False), sizes)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array((100 - rest) / 100.0, mask=lost))


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(obs_id, crop_index, pass_index, text, char_conf): three passes over each
    line; passes misread by rule, confidences are derived."""
    rows = printed_lines(spark, sf_dir).withColumnsRenamed({"line_idx": "crop_index"}).select("obs_id", "crop_index", "text", "pct", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("pass_index"))
    odd = (F.col("obs_id") + F.col("crop_index") * 3 + F.col("pass_index") * 5) % 7
    text = F.when(odd == 0, F.translate("text", "e", "c")).when(odd == 1, F.translate("text", "o", "0")).otherwise(F.col("text"))
    n = F.length(F.regexp_replace("text", r"(?U)\s", ""))
    conf = derived_conf(F.col("obs_id") + F.col("pass_index") * 11, F.lit(5) + F.col("pct") % 30, n)
    return rows.select("obs_id", "crop_index", "pass_index", text.alias("text"), conf.alias("char_conf"))
