"""Error rates, label statistics, font coverage and timing summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind.operators.order import running
from lexbind.operators.store import stored


def error_rates(rows: DataFrame) -> DataFrame:
    """Per pool and overall (pool null): samples, cer, exact_match,
    casefold_exact_match, mean_confidence of (label, prediction, confidence, pool)."""
    edits = F.levenshtein("label", "prediction")
    return rows.groupingSets([[], ["pool"]], "pool").agg(
        F.count("*").alias("samples"),
        (F.sum(edits) / F.sum(F.greatest(F.lit(1), F.length("label")))).alias("cer"),
        F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("exact_match"),
        F.avg((F.lower("label") == F.lower("prediction")).cast("double")).alias("casefold_exact_match"),
        F.avg("confidence").alias("mean_confidence"),
    )


def sample_reasons(samples: DataFrame, files: DataFrame, most: int = 32) -> DataFrame:
    """``samples`` (pos, filename, label) with the first ``reason`` to leave one
    out (duplicate file, missing file, empty, control character, too long), or null."""
    w = Window.partitionBy("filename").orderBy("pos")
    rows = samples.withColumn("_n", F.row_number().over(w)).join(files.select("filename").distinct().withColumn("_has", F.lit(True)), "filename", "left")
    reason = (
        F.when(F.col("_n") > 1, "duplicate")
        .when(F.col("_has").isNull(), "missing")
        .when(F.coalesce("label", F.lit("")) == "", "empty")
        .when(F.col("label").rlike(r"[\x00-\x1F\x7F]"), "control")
        .when(F.length("label") > most, "too_long")
    )
    return rows.withColumn("reason", reason).drop("_n", "_has")


def length_stats(rows: DataFrame, by: str, label: str) -> DataFrame:
    """Count and least, greatest and mean length of labels."""
    n = F.length(label)
    return rows.groupBy(by).agg(F.count("*").alias("samples"), F.min(n).alias("least"), F.max(n).alias("greatest"), F.avg(n).alias("mean"))


def length_histogram(rows: DataFrame, label: str, width: int) -> DataFrame:
    """(bin, n): labels by length in bins of ``width``."""
    return rows.groupBy((F.floor(F.length(label) / width) * width).alias("bin")).agg(F.count("*").alias("n"))


def timing_summary(rows: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Median, P95 (the value at int(0.95 * (n - 1)) of the sorted ones) and maximum.

    Equal values are counted first, so that a value which half of the rows have is
    one row; its places are those of the values before it and its count.
    """
    known = rows.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_c"))
    known = stored(known, "timings")
    sizes = known.groupBy(*by).agg(F.sum("_c").alias("_n"), F.max(column).alias("greatest")).withColumnsRenamed({c: f"_by_{c}" for c in by})
    same = F.lit(True)
    placed = running(known, by, [column], _at=F.col("_c"))
    for c in by:
        same = same & placed[c].eqNullSafe(sizes[f"_by_{c}"])
    placed = placed.join(sizes, same)

    def holds(place):
        return (F.col("_at") <= place) & (place < F.col("_at") + F.col("_c"))

    low, high, late = F.floor((F.col("_n") - 1) / 2), F.ceil((F.col("_n") - 1) / 2), F.floor(0.95 * (F.col("_n") - 1))
    middle = [F.max(F.when(holds(place), F.col(column))) for place in (low, high)]
    return placed.groupBy(*by).agg(((middle[0] + middle[1]) / 2).alias("median"), F.max(F.when(holds(late), F.col(column))).alias("p95"), F.max("greatest").alias("greatest"))


def coverage(fonts: DataFrame, required: DataFrame) -> DataFrame:
    """(filename, set_name, coverage, missing): share of a character set that a
    font (filename, codepoints) has, and what it lacks in order."""
    sets = required.groupBy("set_name").agg(F.array_sort(F.collect_set("codepoint")).alias("need"))
    rows = fonts.crossJoin(F.broadcast(sets))  # a few character sets, one row each
    missing = F.array_except("need", "codepoints")
    return rows.select("filename", "set_name", (1 - F.size(missing) / F.size("need")).alias("coverage"), missing.alias("missing"))


def font_pools(covered: DataFrame, full: float = 1.0) -> DataFrame:
    """(pool, filename): pools by complete sets; multilingual has french and cyrillic."""
    flags = covered.groupBy("filename").agg(*[F.max(F.when(F.col("set_name") == s, F.col("coverage") >= full)).alias(s) for s in ("english", "french", "cyrillic")])
    pools = F.array(F.when(F.col("english"), "latin"), F.when(F.col("french"), "french"), F.when(F.col("cyrillic"), "cyrillic"), F.when(F.col("french") & F.col("cyrillic"), "multilingual"))
    return flags.select(F.explode(F.array_compact(pools)).alias("pool"), "filename")


def dedupe_content(rows: DataFrame, content: str, order: str) -> DataFrame:
    """Rows with ``content_hash``, ``place`` among equal contents and their ``copies``."""
    hashed = stored(rows.withColumn("content_hash", F.sha2(F.col(content).cast("binary"), 256)).drop(content), "hashed")
    sizes = hashed.groupBy(F.col("content_hash").alias("_hash")).agg(F.count("*").alias("copies"))
    placed = running(hashed, ["content_hash"], [order], place=F.lit(1)).withColumn("place", F.col("place") + 1)
    return placed.join(sizes, placed["content_hash"].eqNullSafe(sizes["_hash"])).drop("_hash")


def best_epochs(metrics: DataFrame, tolerance: float = 1e-5, patience: int = 5, by: str = "run") -> DataFrame:
    """``metrics`` (run, epoch, cer, exact) with ``improved`` and ``stale``: epochs of
    the run since the last improvement (a lower error, or an equal one and more exact)."""
    order = Window.partitionBy(by).orderBy("epoch")
    w = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = metrics.withColumn("_best", F.min(F.struct("cer", (-F.col("exact")).alias("minus"))).over(w))
    better = F.col("_best").isNull() | (F.col("cer") < F.col("_best.cer") - tolerance) | ((F.abs(F.col("cer") - F.col("_best.cer")) <= tolerance) & (F.col("exact") > -F.col("_best.minus")))
    rows = rows.withColumn("improved", better)
    last = F.max(F.when(F.col("improved"), F.col("epoch"))).over(order)
    return rows.withColumn("stale", F.col("epoch") - last).withColumn("stop", F.col("stale") >= patience).drop("_best")
