"""Phrase pools from catalog metadata and caller-supplied terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexbind.functions import text as T

POOLS = ("latin", "cyrillic", "mixed", "numeric")


def phrases(values: DataFrame, most: int = 32, upper: bool = True) -> DataFrame:
    """(pool, phrase, origin, variant) of (value, origin, pool) rows; a given
    pool is kept and its value not split, else the script decides."""
    forced = F.col("pool").isNotNull()
    cleaned = values.withColumn("_t", T.lexicon_clean("value")).where(T.is_usable("_t"))
    parts = F.when(forced, F.array("_t")).otherwise(T.chunk_phrase("_t", most))
    rows = cleaned.select("origin", "pool", F.explode(parts).alias("phrase")).where((F.length("phrase") <= most) & T.is_usable("phrase"))
    rows = rows.withColumn("pool", F.coalesce("pool", T.lexicon_script("phrase"))).where("pool <> 'other'")
    plain = rows.select("pool", "phrase", "origin", F.lit(False).alias("variant"))
    if not upper:
        return plain
    big = rows.where("pool in ('latin', 'cyrillic', 'mixed')").select("pool", F.upper("phrase").alias("u"), "phrase", "origin").where((F.col("u") != F.col("phrase")) & (F.length("u") <= most))
    return plain.union(big.select("pool", F.col("u").alias("phrase"), "origin", F.lit(True)))


def catalog_values(catalog: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """(value, origin, pool) rows of catalog columns and vintages."""
    null = F.lit(None).cast("string")

    def rows(c, origin, pool=null):
        return catalog.select(c.alias("value"), F.lit(origin).alias("origin"), pool.alias("pool")).where("value is not null")

    out = rows(F.col("name"), "name")
    for part in (
        rows(F.col("producer"), "producer"),
        rows(F.col("region"), "region"),
        catalog.select(F.explode("style").alias("value"), F.lit("category").alias("origin"), null.alias("pool")),
        catalog.select(F.explode("grapes").alias("value"), F.lit("grape").alias("origin"), null.alias("pool")),
        rows(F.col("year").cast("string"), "year", F.lit("numeric")),
        rows(T.alcohol_text("alcohol_percent"), "alcohol", F.lit("numeric")),
    ):
        out = out.union(part)
    vintages = catalog.sparkSession.range(first_year, last_year + 1).select(F.col("id").cast("string").alias("value"), F.lit("vintage").alias("origin"), F.lit("numeric").alias("pool"))
    return out.union(vintages)


def pools(rows: DataFrame) -> DataFrame:
    """Distinct (pool, phrase), with the unions ``alphabetic`` and ``all``."""
    own = rows.select("pool", "phrase").distinct()
    alphabetic = own.where("pool in ('latin', 'cyrillic', 'mixed')").select(F.lit("alphabetic").alias("pool"), "phrase").distinct()
    return own.union(alphabetic).union(own.where(F.col("pool").isin(*POOLS)).select(F.lit("all").alias("pool"), "phrase").distinct())


def origin_counts(rows: DataFrame) -> DataFrame:
    """(origin, pool, n) before removing repeats, variants not counted."""
    return rows.where("not variant").groupBy("origin", "pool").agg(F.count("*").alias("n"))


def word_counts(values: DataFrame, column: str) -> DataFrame:
    """(word, n) of cleaned text."""
    return values.select(F.explode(T.tokens(T.vocabulary_clean(column))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def charset(labels: DataFrame, base: str, column: str = "label") -> str:
    """Base characters, then the unseen ones by code point."""
    seen = labels.select(F.explode(F.split(column, "")).alias("c")).where("c <> ''").distinct()
    return base + "".join(sorted(r.c for r in seen.collect() if r.c not in base))


def strip_suffixes(rows: DataFrame, column: str, terms: DataFrame) -> DataFrame:
    """``rows`` with ``stripped``: the cleaned text without the longest of the terms
    (``term``; of equally long ones the smallest) that ends it, ignoring case, and
    without the marks and spaces before it; something must stand before it.

    Endings of the lengths that terms have meet the terms by a join, so a term table
    of any size serves; rows are told apart by their text.
    """
    known = terms.select(T.lexicon_clean("term").alias("_term")).where("_term <> ''").distinct()
    lengths = known.agg(F.array_sort(F.collect_set(F.length("_term"))).alias("_lengths"))
    texts = rows.select(F.col(column).alias("_raw")).distinct().withColumn("_text", T.lexicon_clean("_raw"))
    ends = texts.join(F.broadcast(lengths)).select("_raw", "_text", F.explode(F.filter("_lengths", lambda n: n < F.length("_text"))).alias("_n"))
    ends = ends.withColumn("_end", F.lower(F.expr("right(_text, _n)")))
    met = ends.join(known.select(F.lower("_term").alias("_end")).distinct(), "_end").groupBy("_raw").agg(F.max("_n").alias("_n"))
    cut = texts.join(met, "_raw", "left").select("_raw", F.coalesce(F.btrim(F.expr("left(_text, length(_text) - _n)"), F.lit(" ,.-")), "_text").alias("stripped"))
    return rows.join(cut, rows[column].eqNullSafe(cut["_raw"]), "left").drop("_raw")
