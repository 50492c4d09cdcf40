"""Operator 5: near-duplicates by bottom-k sketches of one hash function.

A document's set holds the distinct hashes of its 5-word shingles (ASCII lower
case), 63 bits each: sizes and similarities are exact but for equal hashes of
different shingles, which a document of 20,000 words has with a chance of 2e-11.  Its sketch is the ``SKETCH`` smallest hashes.

1. Documents with equal sets collapse to one node.
2. Inverted lists of retained values generate candidate pairs.  A list key is a
   run of retained values that stand next to each other in the sketch: two for
   small sets, three for large ones (sets in between have both).  Similar sets
   share such runs; sets that share only a passage or a line rarely do.  Small
   lists give all their pairs, larger ones link each member to the list's first.
3. The bottom-k of the union of two sketches estimates their similarity; pairs
   that are clearly below the threshold go (``SLACK`` is over five standard
   errors).
4. Exact Jaccard on full sets decides; pairs travel in groups of one centre and
   about ``FAN`` others.
5. Connected components (hook to the smallest neighbour, contract, repeat).
6. Larger lists whose members are not one component: the members of all lists
   that share the first member's component form a bucket, and those outside the
   component meet all members of the bucket, in blocks of about ``BLOCK``
   members: first by sketches, then those with a near partner by full sets.
   No list, pair or partner is cut.

Chance of a missed link at exactly the threshold: two similar large sets share
no run of three among 48 retained values with probability 0.75 ** 48 = 1e-6; of
sets with fewer shingles, no run of two among 28 with 0.576 ** 28 = 2e-7; sets
that are in the sketch whole always share a run of two.  It falls steeply above
the threshold.

Edge cases: null and empty texts have an empty set and stand alone; a text of
fewer than five words is one shingle; rows with equal ids are judged by their
own sets; rows with null ids take part but never name a component (a group of
null ids only has a null component and is kept); an empty table gives an empty
result; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind.llm.common import drop_stored, free_shuffles, hot_safe_join, release_memory, small_batches, stored, table

WIDTH, PERCENT = 5, 75
SKETCH = 64
#: (values, run length, least and greatest set size) of list keys.
RUNS = ((28, 2, 2, 96), (48, 3, 64, 1 << 30))
SLACK = 0.45
#: Lists up to this give all pairs at once; larger ones star first.
DIRECT = 8
BLOCK = 512
FAN = 64
SALTS = 16
#: Needed documents that a filter is broadcast for; beyond it their texts are joined by shuffle.
BROADCAST_IDS = 100_000

_MULT = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, cache: dict[bytes, int]) -> np.ndarray:
    """Sorted distinct shingle hashes, as non-negative int64."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    if len(cache) > 150_000:
        cache.clear()
    get, digest = cache.get, xxhash.xxh3_64_intdigest
    hashes = []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = digest(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    n = max(1, len(h) - WIDTH + 1)
    total = np.full(n, min(len(h), WIDTH), np.uint64)
    for k in range(min(WIDTH, len(h))):
        total = _mix(total ^ h[k : k + n] * _MULT[k]) + _MULT[k]
    return np.unique((_mix(total) >> np.uint64(1)).astype(np.int64))


def _set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), n, key (of the whole set) and sketch
    (ascending) of every row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for batch in batches:
            sets = [shingle_set(t, cache) for t in batch.column(1).to_pylist()]
            heads = [s[:SKETCH] for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int32)
            values = np.concatenate(heads) if heads else np.zeros(0, np.int64)
            columns = [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int32()), pa.array([_set_key(s) if len(s) else None for s in sets], pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(values))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "digest", "n", "key", "sketch"])
        del cache
        release_memory()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", digest()).mapInArrow(rows, "doc_id long, digest long, n int, key binary, sketch array<long>")


def digest() -> Column:
    """Hash of the text: with the id it tells rows apart, up to equal ones."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest")


def with_group(df: DataFrame, key: Column, spread: Column, **aggs: tuple[Column, str]) -> DataFrame:
    """``df`` with aggregates over all rows of ``key``, safe for hot keys.

    Each aggregate is (column, SQL function that also merges its partial
    results: min, max, sum).  Rows of a key are dealt to SALTS parts by
    ``spread``; only one row for each part and key meets in the second step.
    """
    dealt = df.withColumns({"_g": key, "_s": F.pmod(F.xxhash64(spread), F.lit(SALTS))})
    parts = dealt.groupBy("_g", "_s").agg(*[getattr(F, fn)(c).alias(name) for name, (c, fn) in aggs.items()])
    every = Window.partitionBy("_g")
    parts = parts.withColumns({name: getattr(F, fn)(name).over(every) for name, (_, fn) in aggs.items()})
    return dealt.join(parts, ["_g", "_s"]).drop("_g", "_s")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id that each end of an edge (a, b) reaches.

    Every round hooks each vertex to its smallest neighbour, follows the
    pointers to their roots, and contracts the edges to the roots; each round
    at least halves the vertices that still have edges.
    """
    live = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().where("a <> b"), "edges")
    label = None
    while not live.isEmpty():
        ends = live.union(live.select("b", "a"))
        parent = stored(ends.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("root")), "hooks")
        while True:
            up = parent.select(F.col("id").alias("root"), F.col("root").alias("_next"))
            jumped = hot_safe_join(parent.select("id", "root"), up, "root").select("id", F.col("_next").alias("root"), (F.col("_next") != F.col("root")).alias("moved"))
            before, parent = parent, stored(jumped, "hooks")
            drop_stored(before)
            if parent.where("moved").isEmpty():
                break
        parent = parent.select("id", "root")
        if label is None:
            label = parent
        else:
            ups = parent.select(F.col("id").alias("root"), F.col("root").alias("_next"))
            moved = hot_safe_join(label, ups, "root", "left").select("id", F.coalesce("_next", "root").alias("root"))
            before, label = label, stored(moved, "labels")
            drop_stored(before)
        ra = parent.select(F.col("id").alias("a"), F.col("root").alias("ra"))
        rb = parent.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        moved = hot_safe_join(hot_safe_join(live, ra, "a"), rb, "b", of=live)
        before, live = live, stored(moved.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), "edges")
        drop_stored(before)
    drop_stored(live)
    if label is None:
        return edges.select(F.col("a").alias("id"), F.col("a").alias("component")).limit(0)
    return label.select("id", F.col("root").alias("component"))


def _estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) that the union of their sketches does not rule out."""
    left = nodes.select(F.col("id").alias("a"), F.col("n").alias("_na"), F.col("sketch").alias("_sa"))
    right = nodes.select(F.col("id").alias("b"), F.col("n").alias("_nb"), F.col("sketch").alias("_sb"))
    both = pairs.join(left, "a").join(right, "b")
    both = both.where(F.least("_na", "_nb") * 100 >= F.greatest("_na", "_nb") * PERCENT)
    union = F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, SKETCH)
    both = both.withColumn("_u", union).where(F.size(F.array_intersect(F.array_intersect("_u", "_sa"), F.col("_sb"))) >= SLACK * F.size("_u"))
    return both.select("a", "b")


def _sets(docs: DataFrame, nodes: DataFrame, roles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((a, chunk, id, set) for every role (id, a, chunk), a stored table that it
    reads): full sets of nodes in the groups they belong to; a text is read once
    for all its roles."""
    roles = roles.groupBy("id").agg(F.collect_list(F.struct("a", "chunk")).alias("roles"))
    roles = stored(roles.join(nodes.select("id", F.col("doc_id").alias("_doc"), "key"), "id"), "roles")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    needed = F.broadcast(roles) if roles.count() <= BROADCAST_IDS else roles
    inputs = keyed.join(needed, keyed.doc_id.eqNullSafe(needed._doc)).select("id", "text", "key", F.col("roles.a").alias("a"), F.col("roles.chunk").alias("chunk"))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        names = ["a", "chunk", "id", "set"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for r in batch.to_pylist():
                s = shingle_set(r["text"], cache)
                if _set_key(s) != r["key"]:
                    continue  # another row with this id
                raw = s.tobytes()
                for a, chunk in zip(r["a"], r["chunk"]):
                    out.append((a, chunk, r["id"], raw))
                    held += len(raw)
                    if held > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
        del cache
        release_memory()

    return inputs.mapInArrow(spread, "a long, chunk long, id long, set binary"), roles


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of a stored table whose full sets reach the threshold, stored."""
    grouped = with_group(pairs, F.col("a"), F.col("b"), _c=(F.lit(1), "sum"))
    grouped = grouped.withColumn("chunk", F.pmod(F.xxhash64("b"), F.ceil(F.col("_c") / FAN))).select("a", "b", "chunk")
    roles = grouped.select(F.col("b").alias("id"), "a", "chunk").union(grouped.select(F.col("a").alias("id"), "a", "chunk").distinct())

    def decide(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        sets = {i.as_py(): np.frombuffer(s.as_py(), np.int64) for i, s in zip(group.column("id"), group.column("set"))}
        mine, out = sets[a], []
        for b, s in sets.items():
            if b != a:
                common = len(np.intersect1d(mine, s, assume_unique=True))
                if 100 * common >= PERCENT * (len(mine) + len(s) - common):
                    out.append(b)
        return pa.table([pa.array([a] * len(out), pa.int64()), pa.array(out, pa.int64())], names=["a", "b"])

    sets, used = _sets(docs, nodes, roles)
    out = stored(sets.groupBy("a", "chunk").applyInArrow(decide, "a long, b long"), "links")
    drop_stored(used)
    return out


def _common(owners: np.ndarray, values: np.ndarray, rows: int, minor: np.ndarray) -> np.ndarray:
    """Shared values of each minor row with each row: one pass over the values
    in order, adding a block for each value's holders."""
    slot = np.cumsum(minor) - 1
    out = np.zeros((int(minor.sum()), rows), np.int32)
    order = np.argsort(values, kind="stable")
    owners, values = owners[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if b - a > 1:
            held = owners[a:b]
            mine = held[minor[held]]
            if len(mine):
                out[np.ix_(slot[mine], held)] += 1
    return out


def _blocked(members: DataFrame) -> DataFrame:
    """(a, chunk, id, minor): each member of a bucket in the groups of all pairs
    of blocks that its block is part of."""
    dealt = with_group(members, F.col("a"), F.col("id"), _c=(F.lit(1), "sum")).withColumn("_nb", F.ceil(F.col("_c") / BLOCK))
    dealt = dealt.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_nb")))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1)).alias("_o"))
    return dealt.select("a", (F.least("_b", "_o") * F.col("_nb") + F.greatest("_b", "_o")).alias("chunk"), "id", "minor")


def _near_members(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, id) of bucket members that have a partner, one of the two a minor,
    whose sketch shares enough values."""

    def near(group: pa.Table) -> pa.Table:
        ids = group.column("id").to_numpy()
        n, minor = group.column("n").to_numpy(), group.column("minor").to_numpy(zero_copy_only=False)
        hit = np.zeros(len(ids), bool)
        if minor.any():
            sketch = group.column("sketch").combine_chunks()
            sizes = np.diff(sketch.offsets.to_numpy())
            common = _common(np.repeat(np.arange(len(ids)), sizes), sketch.flatten().to_numpy(), len(ids), minor)
            mine = np.flatnonzero(minor)
            good = common >= SLACK * np.minimum(SKETCH, np.maximum(n[mine][:, None], n[None, :]))
            good &= np.minimum(n[mine][:, None], n[None, :]) * 100 >= np.maximum(n[mine][:, None], n[None, :]) * PERCENT
            good[np.arange(len(mine)), mine] = False
            hit[mine[good.any(axis=1)]] = True
            hit[good.any(axis=0)] = True
        return pa.table([group.column("a").combine_chunks().filter(pa.array(hit)), pa.array(ids[hit])], names=["a", "id"])

    rows = groups.join(nodes.select("id", "n", "sketch"), "id").select("a", "chunk", "id", "minor", "n", "sketch")
    return rows.groupBy("a", "chunk").applyInArrow(near, "a long, id long").distinct()


def _bucket_links(docs: DataFrame, nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Links (a, b) of bucket members by full sets, thinned to a forest in each
    group (components are what they are for)."""

    def exact(group: pa.Table) -> pa.Table:
        sets = {i.as_py(): np.frombuffer(s.as_py(), np.int64) for i, s in zip(group.column("id"), group.column("set"))}
        ids = np.array(sorted(sets), np.int64)
        n = np.array([len(sets[i]) for i in ids.tolist()])
        minor = np.ones(len(ids), bool)
        a, b = [], []
        if len(ids) > 1:
            common = _common(np.repeat(np.arange(len(ids)), n), np.concatenate([sets[i] for i in ids.tolist()]), len(ids), minor)
            x, y = np.nonzero(np.triu(100 * common.astype(np.int64) >= PERCENT * (n[:, None] + n[None, :] - common), 1))
            root = list(range(len(ids)))

            def find(k):
                while root[k] != k:
                    root[k] = root[root[k]]
                    k = root[k]
                return k

            for p, q in zip(x.tolist(), y.tolist()):
                rp, rq = find(p), find(q)
                if rp != rq:
                    root[max(rp, rq)] = min(rp, rq)
                    a.append(int(ids[p]))
                    b.append(int(ids[q]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sets, used = _sets(docs, nodes, groups.select("id", "a", "chunk"))
    out = stored(sets.groupBy("a", "chunk").applyInArrow(exact, "a long, b long"), "links")
    drop_stored(used)
    return out


def _keys(nodes: DataFrame) -> DataFrame:
    """(g, id): list keys, hashes of runs of neighbouring retained values."""
    parts = []
    for values, run, least, most in RUNS:
        kept = F.slice("sketch", 1, values)
        starts = F.sequence(F.lit(1), F.size("_v") - (run - 1))
        mine = nodes.where(F.col("n").between(least, most - 1)).select("id", kept.alias("_v")).where(F.size("_v") >= run)
        mine = mine.select("id", "_v", F.explode(starts).alias("_p"))
        parts.append(mine.select(F.xxhash64(F.lit(run), *[F.element_at("_v", F.col("_p") + k) for k in range(run)]).alias("g"), "id"))
    return parts[0].union(parts[1])


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored rows: doc_id, digest, n, tag, node and more; labels: id, component
    of linked nodes)."""
    spark = docs.sparkSession
    small_batches(spark)
    base = stored(sketches(docs).withColumn("tag", F.monotonically_increasing_id()), "sketches")
    lead = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "tag")
    full = with_group(base.where("key is not null"), F.col("key"), F.col("tag"), lead=(lead, "min"))
    full = full.select("doc_id", "digest", "n", "key", "tag", F.col("lead.tag").alias("node"), F.when(F.col("lead.tag") == F.col("tag"), F.col("sketch")).alias("sketch"))
    alone = base.where("key is null").select("doc_id", "digest", "n", "key", "tag", F.col("tag").alias("node"), "sketch")
    rows = stored(full.union(alone), "rows")
    drop_stored(base)
    nodes = rows.where("tag = node and key is not null").select(F.col("node").alias("id"), "doc_id", "n", "key", "sketch")

    keys = _keys(nodes)
    shared = keys.groupBy("g").agg(F.count("*").alias("c"), F.min("id").alias("first")).where("c > 1")
    shared = stored(shared, "shared")
    lists = stored(hot_safe_join(keys, shared, "g", count="c"), "lists")
    drop_stored(shared)
    free_shuffles(spark)
    few = lists.where(F.col("c") <= DIRECT)
    all_pairs = few.alias("x").join(few.alias("y"), "g").where("x.id < y.id").select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    large = lists.where(F.col("c") > DIRECT)
    stars = large.where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    pairs = stored(_estimated(all_pairs.union(stars).distinct(), nodes), "pairs")
    free_shuffles(spark)
    edges = verify(docs, nodes, pairs)
    drop_stored(pairs)
    labels = components(edges)
    free_shuffles(spark)

    # Large lists that are not one component.
    firsts = labels.select(F.col("id").alias("first"), F.col("component").alias("_fc"))
    marked = hot_safe_join(large.join(labels, "id", "left"), firsts, "first", "left", of=large)
    marked = marked.select("g", "id", F.coalesce("_fc", "first").alias("a"), (F.coalesce("component", "id") != F.coalesce("_fc", "first")).alias("minor"))
    marked = stored(marked, "marked")
    drop_stored(lists)
    mixed = marked.groupBy("g").agg(F.max("minor").alias("mixed"), F.count("*").alias("c")).where("mixed")
    members = stored(hot_safe_join(marked, stored(mixed, "mixed"), "g", count="c").select("a", "id", "minor").distinct(), "members")
    drop_stored(marked)
    free_shuffles(spark)
    if members.isEmpty():
        drop_stored(edges)
        return rows, labels
    near = stored(_near_members(_blocked(members), nodes), "near")
    free_shuffles(spark)
    if near.isEmpty():
        drop_stored(edges)
        return rows, labels
    more = _bucket_links(docs, nodes, _blocked(members.join(near, ["a", "id"], "left_semi")))
    drop_stored(members)
    drop_stored(near)
    if not more.isEmpty():
        labels = components(edges.union(more))
    drop_stored(edges)
    drop_stored(more)
    free_shuffles(spark)
    return rows, labels


def _decided(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n, component_id and stay (one row of each component: the
    first of those with the smallest id; null ids last)."""
    rows, labels = link(docs)
    grouped = hot_safe_join(rows.select("doc_id", "digest", "n", "tag", F.col("node").alias("id")), labels, "id", "left")
    lead = F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("doc_id"), "tag")
    out = with_group(grouped, F.coalesce("component", "id"), F.col("tag"), component_id=(F.col("doc_id"), "min"), lead=(lead, "min"))
    return out.select("doc_id", "digest", "n", "component_id", (F.col("lead.tag") == F.col("tag")).alias("stay"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row."""
    return _decided(docs).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, with all columns of ``docs``: that with the
    smallest id.  Of rows with equal ids and texts one stays (the one whose other
    columns hash lowest); rows with equal ids and different texts are judged one
    by one; of a component without ids one row stays."""
    names = docs.columns
    decided = stored(_decided(docs), "decided")
    each = decided.groupBy("doc_id", "digest").agg(F.max("stay").alias("stay"), F.count("*").alias("c"))
    marked = docs.select(F.col("doc_id").cast("long").alias("_id"), digest().alias("_digest"), *[F.col(c).alias(f"_k{i}") for i, c in enumerate(names)])

    def by_row(rows: DataFrame) -> Column:
        return marked["_id"].eqNullSafe(rows["doc_id"]) & (marked["_digest"] == rows["digest"])

    gone, twice = each.where("not stay"), each.where("stay and c > 1")
    kept = marked.join(gone, by_row(gone), "left_anti")
    if not twice.isEmpty():
        one = kept.join(twice, by_row(twice), "left_semi").groupBy("_id", "_digest")
        plain = [f"_k{i}" for i, f in enumerate(docs.schema) if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        whole = F.struct(*[F.col(f"_k{i}") for i in range(len(names))])
        one = one.agg(F.min_by(whole, F.xxhash64(*plain)).alias("_row")).select("_row.*")
        kept = kept.join(twice, by_row(twice), "left_anti").select(*one.columns).union(one)
    return kept.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(names)])


def op5_bottomk_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate ``documents``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
