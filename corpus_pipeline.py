"""Training-data pipeline: quality, near-duplicates, leaks, personal data, tokens.

Each stage takes (spark, docs, sf_dir) and works on all its predecessor kept;
all but the last return the columns of ``documents``.  ``run`` applies them to
``documents``; each stage's rows are written and read again before the next.

The rows of the end result cannot be had from SQL (the quality model, the
retrieval and the trees have no SQL form), so ORACLE_SQL is None and tests
compare the stages with brute-force versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm import latent, neardup, pieces, pii, quality
from lexbind.llm.common import stored, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the quality rules reject (operator 3)."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: that with the smallest
    id (operator 5); rows are told apart by id and text."""
    return neardup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item (operator 7)."""
    return latent.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind (operator 6); n_chars follows the text."""
    scanned = pii.scan(docs, tuple(docs.columns))
    out = pii.redact(scanned, *pii.fit(scanned))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))
    return out.select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every text and their round trip (operator 10)."""
    import public_tokenizers

    extra = tuple(c for c in ("lang", "source", "n_chars") if c in docs.columns)
    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), extra, with_ids=True)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_copy),
    ("leaks", drop_leaks),
    ("personal_data", redact_personal),
    ("pieces", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
