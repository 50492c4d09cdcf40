"""Operator 12: near-duplicates by SimHash and meet-in-the-middle ball hashing.

A document's fingerprint takes, for each of 64 bits, the majority of the XXH64 hashes
(seed 42) of its 3-word shingles, repeats included.  Rows with one fingerprint are one
node.  Two fingerprints at ``RADIUS`` = 2 or fewer differing bits have a number half
way, at most one bit from either: every distinct fingerprint emits its 65 numbers
within one bit, numbers that several fingerprints emit give pairs, and each pair is
taken once and verified.  At most 65 distinct fingerprints lie within one bit of any
number, so no group is large, however many documents are copies.

Edge cases: null and empty texts have fingerprint 0 and are linked like any other; one
or two words are one shingle; a text of any length is one shingle list; rows with
equal ids are separate rows; rows with null ids take part but never name a component
(a component of null ids only has a null component); an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import drop_stored, free_shuffles, hot_safe_join, release_memory, small_batches, stored, table
from lexbind.llm.neardup import components

WIDTH, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Shingles whose bits are counted at one time.
CHUNK = 1 << 16

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of every shingle of a text, in order."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    held, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < WIDTH:
        return np.array([digest(held, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    ends = (ends - 1).tolist()
    return np.fromiter((digest(held[a:b], SEED) for a, b in zip(starts, ends[WIDTH - 1 :])), np.uint64, len(words) - WIDTH + 1)


def fingerprint(text: bytes | None) -> int:
    """The fingerprint as an unsigned number."""
    hashes = shingle_hashes(text or b"")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * ones > len(hashes)).tolist())


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits): the fingerprint of every row, as a signed number."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, np.uint64).view(np.int64))], ["doc_id", "bits"])
        release_memory()

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, "doc_id long, bits long")


def ball(bits: str) -> Column:
    """All numbers within RADIUS / 2 = 1 bit of a fingerprint."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda k: F.col(bits).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)))
    return F.array_append(flips, F.col(bits))


def near_pairs(nodes: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) of fingerprints with RADIUS or fewer differing bits."""
    variants = nodes.select(F.explode(ball("bits")).alias("v"), "bits")
    met = variants.groupBy("v").agg(F.count("*").alias("c"), F.min("bits").alias("low"), F.max("bits").alias("high")).where("c > 1")
    met = stored(met, "met")
    # Where two fingerprints meet they are the ends; where more do, all are read again.
    crowd = met.where("c > 2").select("v")
    members = variants.join(crowd, "v")
    pairs = members.alias("x").join(members.alias("y"), "v").where("x.bits < y.bits").select(F.col("x.bits").alias("a"), F.col("y.bits").alias("b"))
    pairs = met.where("c = 2").select(F.col("low").alias("a"), F.col("high").alias("b")).union(pairs)
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row."""
    rows = stored(fingerprints(docs), "fingerprints")
    nodes = stored(rows.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "nodes")
    edges = stored(near_pairs(nodes), "links")
    free_shuffles(docs.sparkSession)
    labels = components(edges).withColumnRenamed("id", "bits")
    drop_stored(edges)
    grouped = nodes.join(labels, "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    least = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    named = stored(hot_safe_join(grouped, least, "component").select("bits", "component_id", "copies"), "named")
    out = hot_safe_join(rows, named, "bits", count="copies")
    return out.select("doc_id", F.lpad(F.lower(F.hex("bits")), 16, "0").alias("fingerprint"), "component_id")


def op12_simhash_balls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` by fingerprints."""
    return near_duplicates(table(spark, sf_dir, "documents"))
