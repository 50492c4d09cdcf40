"""Operator 8: consistent-hash ring with virtual nodes and bounded loads.

Every row hashes to a point of a ring; each shard owns ``vnodes`` arcs.  A
shard's load is bounded by an exact quota (floor or ceil of rows / shards, so
that the quotas sum to the number of rows); rows of an arc whose shard is full
continue clockwise to the next arcs' shards.  Row counts of the shards are
hence at most one apart (law ``rows``), and a row moves only if its arc's owner
is full.  Rows with equal keys share a point, so they stay together unless
their shard overflows.

Everything runs as DataFrame expressions.  What reaches the driver is one row
for each (arc, sub-bucket): at most shards * vnodes * SUBS counts, whatever the
input's size.  Ranks inside an arc come from those counts plus a row_number
inside a sub-bucket, so a key that holds a third of all rows is ranked by SUBS
tasks.

Edge cases: null text counts as size 1 and hashes as the empty text; equal rows
(even with equal ids) get distinct slots; an empty table gives an empty result;
other columns pass through if named in ``keep``.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind.llm.common import kept_name, table

#: Sub-buckets of an arc.
SUBS = 64


def ring_points(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) of all virtual nodes in ring order; points are 63-bit."""
    points = []
    for shard in range(shards):
        for v in range(vnodes):
            digest = hashlib.sha256(f"shard-{shard}/vnode-{v}".encode()).digest()
            points.append((int.from_bytes(digest[:8], "big") >> 1, shard))
    return sorted(points)


def fill(counts: list[int], owners: list[int], quotas: list[int]) -> list[tuple[int, int, int, int]]:
    """Segments (arc, shard, first rank in the arc, rows).

    Owners serve their own arcs first, in ring order; what a full owner cannot
    take moves on one arc at a time until a shard with room meets it.
    """
    left, free = list(counts), list(quotas)
    taken = [0] * len(counts)
    out = []
    for step in range(len(owners)):
        if not any(left):
            break
        for arc in range(len(owners)):
            shard = owners[(arc + step) % len(owners)]
            n = min(left[arc], free[shard])
            if n:
                out.append((arc, shard, taken[arc], n))
                taken[arc] += n
                left[arc] -= n
                free[shard] -= n
    return out


def _arc(point: Column, points: list[tuple[int, int]]) -> Column:
    """Index of the first virtual node at or after a point, clockwise: a binary
    search written as nested conditions (depth log2 of the nodes)."""

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo % len(points))
        mid = (lo + hi) // 2
        return F.when(point <= F.lit(points[mid][0]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(points))


def bounded_ring(df: DataFrame, key: Column, order: list[Column], shards: int, vnodes: int = 64) -> DataFrame:
    """Add ``shard`` (int), ``slot`` (long, gapless from 0 in each shard) and
    ``home_shard`` (the owner of the key's arc, whether or not it was full).

    ``key`` decides the point; ``order`` breaks ties inside a sub-bucket.  Input
    columns with these names are kept as ``input_`` and the name.
    """
    spark = df.sparkSession
    own = ["home_shard", "shard", "slot"]
    df = df.withColumnsRenamed({c: kept_name(c, own) for c in df.columns if c in own})
    points = ring_points(shards, vnodes)
    owners = [s for _, s in points]
    placed = df.withColumn("_point", F.shiftrightunsigned(F.xxhash64(key), 1))
    placed = placed.withColumn("_arc", _arc(F.col("_point"), points)).withColumn("_sub", F.pmod(F.xxhash64(F.lit("sub"), *order), F.lit(SUBS)).cast("int"))
    counted = {(r[0], r[1]): r[2] for r in placed.groupBy("_arc", "_sub").count().collect()}
    per_arc = [sum(counted.get((a, s), 0) for s in range(SUBS)) for a in range(len(points))]
    total = sum(per_arc)
    quotas = [total // shards + (s < total % shards) for s in range(shards)]
    segments, used = [], [0] * shards
    for arc, shard, first, n in fill(per_arc, owners, quotas):
        segments.append((arc, shard, first, first + n, used[shard]))
        used[shard] += n
    of_arc: dict[int, list] = {}
    for arc, *segment in segments:
        of_arc.setdefault(arc, []).append(segment)
    starts = []
    for a, mine in of_arc.items():
        at = k = 0
        for s in range(SUBS):
            n = counted.get((a, s), 0)
            # Segments of an arc and its sub-buckets both follow its ranks.
            while n and k < len(mine):
                shard, first, last, slot = mine[k]
                begin, end = max(first, at), min(last, at + n)
                starts.append((a, s, owners[a], shard, begin - at, end - at, slot + begin - first))
                if last > at + n:
                    break
                k += 1
                if last == at + n:
                    break
            at += n
    pieces = spark.createDataFrame(starts, "_arc int, _sub int, home_shard int, shard int, _from long, _to long, _slot long")
    ranked = placed.withColumn("_rank", F.row_number().over(Window.partitionBy("_arc", "_sub").orderBy(*order)).cast("long") - 1)
    # At most shards * vnodes * SUBS + shards * vnodes pieces: a bound that the input does not move.
    joined = ranked.join(F.broadcast(pieces), ["_arc", "_sub"]).where("_rank >= _from and _rank < _to")
    return joined.withColumn("slot", F.col("_slot") + F.col("_rank") - F.col("_from")).drop("_point", "_arc", "_sub", "_rank", "_from", "_to", "_slot")


def op8_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` into 8 shards under the law ``rows``; equal texts share a point."""
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("_key"),
    )
    out = bounded_ring(docs, F.col("_key"), [F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("_key")], 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "home_shard")
