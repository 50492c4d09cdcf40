"""Allocation of sample counts, seeds, and leakage-free splits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from lexbind.operators.order import running
from lexbind.operators.store import stored


def largest_remainder(pools: DataFrame, total: int) -> DataFrame:
    """(pos, pool, ratio, count): counts that sum to ``total``; what rounding
    down leaves goes to the largest fractions, ties to the first pool."""
    every = Window.partitionBy(F.lit(0))
    exact = F.col("ratio") * total
    rows = pools.withColumns({"_f": F.floor(exact), "_r": exact - F.floor(exact)})
    rows = rows.withColumns({"_n": F.row_number().over(every.orderBy(F.desc("_r"), "pos")), "_left": total - F.sum("_f").over(every)})
    return rows.select("pos", "pool", "ratio", (F.col("_f") + (F.col("_n") <= F.col("_left")).cast("long")).alias("count"))


def split_extended(count: Column, extended: Column) -> Column:
    """Rows of a pool for its extended-Latin share: a quarter (half to even), at
    least 1, if it has any."""
    return F.when(extended > 0, F.greatest(F.lit(1), F.bround(count * 0.25).cast("long"))).otherwise(0)


def font_pool(preferred: Column, available: Column) -> Column:
    """The first pool with fonts: the preferred one, the multilingual one for
    french and cyrillic, the latin one, the flat folder."""
    second = F.when(preferred.isin("french", "cyrillic"), F.lit("multilingual"))
    chain = F.array_compact(F.array(preferred, second, F.lit("latin")))
    return F.coalesce(F.try_element_at(F.filter(chain, lambda p: F.array_contains(available, p)), F.lit(1)), F.lit("flat"))


def item_seed(seed: Column, job: Column, name: Column) -> Column:
    """Unsigned 64-bit seed: the first eight bytes, little-endian, of
    sha256("seed|job|name")."""
    digest = F.substr(F.sha2(F.concat_ws("|", seed.cast("string"), job, name), 256), F.lit(1), F.lit(16))
    swapped = F.concat(*[F.substr(digest, F.lit(1 + 2 * k), F.lit(2)) for k in range(7, -1, -1)])
    return F.conv(swapped, 16, 10).cast("decimal(20,0)")


def label_key(label: Column | str, seed: int) -> Column:
    """Digest that stands for a label, ignoring case; its order is that of the draw."""
    return F.unhex(F.sha2(F.concat(F.lit(f"{seed}|"), F.lower(label)), 256))


def grouped_split(samples: DataFrame, fraction: float, seed: int) -> DataFrame:
    """``samples`` (sample_id, label, pool) with ``fold``: whole label groups
    (ignoring case) go to ``val`` until each pool has its fraction; at least one
    group of a pool stays in ``train``.  ``label_key`` (:func:`label_key` of the seed)
    may stand for the label."""
    # Labels meet as digests: short rows, and the order of the draw is theirs alone.
    folded = samples.withColumn("_k", F.col("label_key") if "label_key" in samples.columns else label_key("label", seed))
    groups = stored(folded.where("_k is not null").groupBy("_k").agg(F.min_by("pool", "sample_id").alias("_p"), F.count("*").alias("_n")), "groups")
    sizes = groups.groupBy("_p").agg(F.sum("_n").alias("_rows"), F.count("*").alias("_groups"))
    placed = running(groups, ["_p"], ["_k"], _before=F.col("_n"), _place=F.lit(1)).withColumnRenamed("_p", "_q")
    placed = placed.join(F.broadcast(sizes), placed["_q"].eqNullSafe(sizes["_p"]))
    target = F.greatest(F.lit(1), F.bround(F.col("_rows") * fraction).cast("long"))
    placed = placed.withColumn("fold", F.when((F.col("_before") < target) & (F.col("_groups") - F.col("_place") > 1), "val").otherwise("train"))
    return folded.join(placed.select("_k", "fold"), "_k").drop("_k")


def leakage(split: DataFrame) -> DataFrame:
    """Labels (ignoring case; their keys, where those stand for them) on both sides;
    must be empty."""
    shown = F.lower("label") if "label" in split.columns else F.col("label_key")
    rows = split.where("fold in ('train', 'val')").select(shown.alias("label"), "fold")
    sides = rows.groupBy(F.sha2(F.col("label").cast("binary"), 256).alias("_h")).agg(F.min("fold").alias("_a"), F.max("fold").alias("_b"), F.min("label").alias("label"))
    return sides.where("_a <> _b").select("label")


def fingerprint(labels: DataFrame, by: list[str], label: str = "label") -> DataFrame:
    """sha256 of each group's sorted case-folded labels, one a line.

    A group's labels stream through one task in order; nothing of it is held.
    """
    rows = labels.select(F.struct(*by).alias("by"), F.lower(label).alias("label")).where("label is not null")
    dealt = rows.repartition("by").sortWithinPartitions("by", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, digest, done = None, None, []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if digest is None or key != group:
                    if digest is not None:
                        done.append((group, digest.hexdigest()))
                    group, digest = key, hashlib.sha256(text.encode())
                else:
                    digest.update(b"\n" + text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], kind), pa.array([d for _, d in done])], ["by", "fingerprint"])
                done = []
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([digest.hexdigest()])], ["by", "fingerprint"])

    schema = StructType([rows.schema["by"], StructField("fingerprint", StringType())])
    kind = to_arrow_type(rows.schema["by"].dataType)
    return dealt.mapInArrow(run, schema).select("by.*", "fingerprint")


def with_variants(labels: DataFrame, variants: int) -> DataFrame:
    """Every row once as baseline and once for each variant."""
    return labels.select("*", F.explode(F.sequence(F.lit(0), F.lit(variants))).alias("variant"))


def metadata_of(files: DataFrame, metadata: DataFrame, pattern: str) -> DataFrame:
    """Files with the metadata whose id their name holds; missing stays null."""
    return files.withColumn("id", F.nullif(F.regexp_extract("filename", pattern, 1), F.lit(""))).join(metadata, "id", "left")
