"""Operator 11: collocations of two and three words from merged count tries.

1. Every task builds depth-limited count tries (up to three words) of the texts it
   reads, one shard for about ``SHARD_WORDS`` words of a language, and serialises
   them depth first: the nodes in order of their words' bytes, as packed differences.
2. Borders between prefix ranges come from marks that every block of every shard
   leaves at even distances (they decide balance only, never results).
3. Blocks are cut at the borders and each range merges its sorted runs.  A walk over
   the merged trie gives every node the counts of its ancestors, which are the left
   parts; ancestors that lie before the range's first node are looked up afterwards.
4. Suffix links give the right parts: a node of two words links to its last word, a
   node of three to its last two, which has a link of its own.  Parts occur at least
   as often as the phrase, so only nodes with ``LEAST`` occurrences are linked.

A range holds about ``RANGE_NODES`` nodes whatever the language or first word; one
phrase adds at most one node for each shard.  Scores are exact (decimals of 38
digits).

Edge cases: a null text is empty, a null language is ``und``; a text of any length is
read in slices that end between words; equal rows count each; an empty table gives an
empty result; other columns do not matter.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind.llm.common import drop_stored, free_shuffles, hot_safe_join, release_memory, small_batches, stored, table

#: Occurrences of a candidate, share of it in a longer one that drops it, results a language.
LEAST, INSIDE_PERCENT, TOP = 10, 50, 2000
#: Words of a shard, distinct words that close a shard, bytes of them that do.
SHARD_WORDS, SHARD_VOCABULARY, SHARD_BYTES = 3_000_000, 900_000, 48_000_000
#: Bytes of text that are words at one time; nodes of a block; nodes between marks; nodes of a range.
SLICE, BLOCK_NODES, MARK, RANGE_NODES = 4_000_000, 1 << 17, 2048, 1_000_000
#: Marks that the driver sees.
MARKS = 100_000
#: Parts that a language's candidates are ranked in, step by step.
RANK_PARTS = (256, 16, 4)

#: Stands for every border between pieces; no byte of UTF-8.
BORDER = b"\xff"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + b"\t" + b".,;:!?\n\x0b\x0c\r", bytes(range(97, 123)) + b" " + BORDER * 10)


class _Ids(dict):
    """Numbers words as they come; the border is 0."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.bytes += len(word)
        return n

    def __init__(self):
        super().__init__({BORDER: 0})
        self.bytes = 0


def slices(texts: list[bytes]) -> Iterator[list[bytes]]:
    """The words and borders of texts, in lists of about SLICE bytes."""
    held = BORDER.join(texts) + BORDER
    at = 0
    while at < len(held):
        end = min(at + SLICE, len(held))
        if end < len(held):
            # A cut inside a word moves to the next place between words.
            ends = [e for e in (held.find(c, end) for c in (b" ", b"\t", b"\n", BORDER)) if e >= 0]
            end = min(ends) if ends else len(held)
        yield held[at:end].translate(_TABLE).replace(BORDER, b" \xff ").split()
        at = end


class Shard:
    """A count trie in the making: the stream of a language's words."""

    def __init__(self, before: list[bytes]):
        self.ids = _Ids()
        self.parts = [np.array([self.ids[w] for w in before], np.int32)]
        self.carried = len(before)
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        self.parts.append(np.fromiter(map(self.ids.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def full(self) -> bool:
        return self.size >= SHARD_WORDS or len(self.ids) >= SHARD_VOCABULARY or self.ids.bytes >= SHARD_BYTES

    def trie(self) -> tuple[list[bytes], np.ndarray, np.ndarray, list[bytes]]:
        """(words in order, node keys in order, counts, last two words).  A key is
        three digits to the base of words + 1; 0 is no word.  Phrases count where
        they end, so that those across two shards count once."""
        words = sorted(self.ids.keys() - {BORDER})
        rank = np.zeros(len(self.ids), np.int64)
        rank[[self.ids[w] for w in words]] = np.arange(1, len(words) + 1)
        stream = np.concatenate(self.parts)
        x, base, c = rank[stream], len(words) + 1, self.carried
        last = [words[r - 1] if r else BORDER for r in x[-2:].tolist()]
        keys = [x[c:][x[c:] > 0] * base * base]
        for k in (1, 2):
            s = max(c, k)
            if len(x) <= s:
                continue
            columns = [x[s - j : len(x) - j] for j in range(k, -1, -1)]
            ok = np.logical_and.reduce([v > 0 for v in columns])
            columns = [v[ok] for v in columns]
            keys.append((columns[0] * base + columns[1]) * base + (columns[2] if k == 2 else 0))
        nodes, counts = np.unique(np.concatenate(keys), return_counts=True)
        return words, nodes, counts, last


def pack(values: np.ndarray) -> bytes:
    """Compressed 64-bit numbers, bytes of equal weight together."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values, "<i8").view(np.uint8).reshape(-1, 8).T.tobytes())


def unpack(image: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(image), np.uint8).reshape(8, -1).T.copy().view("<i8").ravel().astype(np.int64)


def digits(nodes: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    upper, third = np.divmod(nodes, base)
    first, second = np.divmod(upper, base)
    return first, second, third


def block(words: list[bytes], nodes: np.ndarray, counts: np.ndarray, base: int) -> dict:
    """One serialised run of sorted nodes with the words that it uses."""
    import zstandard

    one, two, three = digits(nodes, base)
    used = np.unique(np.concatenate([[0], one, two, three]))
    to = np.zeros(int(used[-1]) + 1, np.int64)
    to[used] = np.arange(len(used))
    keys = (to[one] * len(used) + to[two]) * len(used) + to[three]
    held = b" ".join([words[r - 1] for r in used[1:].tolist()])
    marks = range(zlib.crc32(held) % MARK, len(nodes), MARK)
    return {
        "n": len(nodes), "tokens": int(counts[two == 0].sum()), "words": zstandard.ZstdCompressor(level=1).compress(held),
        "keys": pack(np.diff(keys, prepend=0)), "counts": pack(counts),
        "marks": [b" ".join(words[r - 1] for r in (one[i], two[i], three[i]) if r).decode() for i in marks],
    }


def read_block(row: dict) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    import zstandard

    held = zstandard.ZstdDecompressor().decompress(row["words"])
    return held.split(b" ") if held else [], np.cumsum(unpack(row["keys"])), unpack(row["counts"])


_BLOCK = {"lang": pa.string(), "n": pa.int64(), "tokens": pa.int64(), "words": pa.binary(), "keys": pa.binary(), "counts": pa.binary(), "marks": pa.list_(pa.string())}
_BLOCK_DDL = "lang string, n long, tokens long, words binary, keys binary, counts binary, marks array<string>"


def _batch(rows: list[dict], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in kinds.items()], list(kinds))


def tries(docs: DataFrame) -> DataFrame:
    """Serialised count tries of the texts: blocks of sorted nodes by language."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards: dict[str, Shard] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            words, nodes, counts, last = shards.pop(lang).trie()
            base = len(words) + 1
            for at in range(0, len(nodes), BLOCK_NODES):
                cut = slice(at, at + BLOCK_NODES)
                yield _batch([{"lang": lang, **block(words, nodes[cut], counts[cut], base)}], _BLOCK)
            shards[lang] = Shard(last)

        for batch in batches:
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text:
                    by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                for words in slices(texts):
                    shards.setdefault(lang, Shard([BORDER])).add(words)
                    if shards[lang].full():
                        yield from flush(lang)
                    elif sum(s.size for s in shards.values()) >= SHARD_WORDS:
                        yield from flush(max(shards, key=lambda k: shards[k].size))
        for lang in list(shards):
            yield from flush(lang)
        shards.clear()
        release_memory()

    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, _BLOCK_DDL)


def borders(blocks: DataFrame) -> list[tuple[bytes, ...]]:
    """First (language, words) of every prefix range but the first, in order."""
    total = blocks.agg(F.sum("n")).first()[0] or 0
    ranges = -(-total // RANGE_NODES)
    if ranges < 2:
        return []
    marks = blocks.select("lang", F.explode("marks").alias("mark")).orderBy(F.xxhash64("mark", "lang")).limit(MARKS).collect()
    keys = sorted((r.lang.encode(), *r.mark.encode().split(b" ")) for r in marks)
    return sorted({keys[len(keys) * k // ranges] for k in range(1, ranges)}) if keys else []


def _ranged(blocks: DataFrame, cuts: list[tuple[bytes, ...]]) -> DataFrame:
    """Blocks cut at the borders, with the number of their range."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"range": pa.int32(), **{c: t for c, t in _BLOCK.items() if c not in ("marks", "tokens")}}
        for batch in batches:
            for r in batch.to_pylist():
                words, nodes, counts = read_block(r)
                base, lang = len(words) + 1, r["lang"].encode()

                def key(i: int) -> tuple[bytes, ...]:
                    return (lang, *[words[int(d) - 1] for d in (nodes[i] // base // base, nodes[i] // base % base, nodes[i] % base) if d])

                part, at = bisect.bisect_right(cuts, key(0)), 0
                while at < len(nodes):
                    end = len(nodes) if part == len(cuts) else bisect.bisect_left(range(len(nodes)), cuts[part], lo=at, key=key)
                    if end > at:
                        piece = r if end - at == len(nodes) else {"lang": r["lang"], **block(words, nodes[at:end], counts[at:end], base)}
                        yield _batch([{"range": part, **piece}], kinds)
                    part, at = part + 1, end

    return blocks.select("lang", "n", "words", "keys", "counts").mapInArrow(rows, "range int, lang string, n long, words binary, keys binary, counts binary")


_NODE = {"range": pa.int32(), "lang": pa.string(), "head": pa.bool_(), "w1": pa.string(), "w2": pa.string(), "w3": pa.string(), "a": pa.int64(), "up1": pa.int64(), "up2": pa.int64()}
_NODE_DDL = "range int, lang string, head boolean, w1 string, w2 string, w3 string, a long, up1 long, up2 long"


def merge(group: pa.Table) -> pa.Table:
    """The nodes of a prefix range with LEAST occurrences and their ancestors'
    counts (null where the ancestor lies before the range), and for each language
    the range's first node (``head``)."""
    part, out = group.column("range")[0].as_py(), []
    langs = group.column("lang").to_pylist()
    for lang in sorted(set(langs)):
        runs = [read_block(r) for r in group.filter(pa.array([g == lang for g in langs])).to_pylist()]
        words = sorted(set().union(*[w for w, _, _ in runs]))
        place = {w: i + 1 for i, w in enumerate(words)}
        uppers, lowers = [], []
        for held, nodes, _ in runs:
            to = np.array([0, *[place[w] for w in held]], np.int64)
            one, two, three = (to[d] for d in digits(nodes, len(held) + 1))
            uppers.append(one * (len(words) + 1) + two)
            lowers.append(three)
        counts = np.concatenate([c for _, _, c in runs])
        upper, lower = np.concatenate(uppers), np.concatenate(lowers)
        order = np.lexsort((lower, upper))
        upper, lower, counts = upper[order], lower[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], (upper[1:] != upper[:-1]) | (lower[1:] != lower[:-1])]))
        a = np.add.reduceat(counts, first)
        one, two = np.divmod(upper[first], len(words) + 1)
        three = lower[first]
        # The walk: the last node of depth one or two that was passed.
        here = np.arange(len(a))
        above1 = np.maximum.accumulate(np.where(two == 0, here, -1))
        above2 = np.maximum.accumulate(np.where((two > 0) & (three == 0), here, -1))
        # A node of depth two belongs to the path only below its own parent.
        above2 = np.where(above2 > above1, above2, -1)
        kept = np.flatnonzero(a >= LEAST)
        up1 = [int(a[above1[i]]) if above1[i] >= 0 else None for i in kept.tolist()]
        up2 = [int(a[above2[i]]) if above2[i] >= 0 else None for i in kept.tolist()]
        kept = np.concatenate([[0], kept])
        texts = pa.array(["", *[w.decode() for w in words]])
        columns = [texts.take(pa.array(d[kept])) for d in (one, two, three)]
        n = len(kept)
        out.append(pa.table([pa.array([part] * n, pa.int32()), pa.array([lang] * n), pa.array([True] + [False] * (n - 1)), *columns, pa.array(a[kept]), pa.array([None, *up1], pa.int64()), pa.array([None, *up2], pa.int64())], schema=pa.schema(list(_NODE.items()))))
    return pa.concat_tables(out)


def frequent_nodes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((lang, w1, w2, w3, a, up1, up2): nodes with LEAST occurrences, absent words
    empty, with the counts of their first and first two words; (lang, n))."""
    spark = docs.sparkSession
    small_batches(spark)
    blocks = stored(tries(docs), "tries")
    cuts = borders(blocks)
    merged = stored(_ranged(blocks, cuts).groupBy("range").applyInArrow(merge, _NODE_DDL), "nodes")
    words = stored(blocks.groupBy("lang").agg(F.sum("tokens").alias("n")), "words")
    drop_stored(blocks)
    free_shuffles(spark)
    nodes = merged.where("not head").drop("head")
    # What lies before a range is the path to its first node: one row a range and language.
    heads = merged.where("head").select("range", "lang", "w1", "w2")
    one = nodes.where("w2 = ''").select("lang", "w1", F.col("a").alias("fix1"))
    two = nodes.where("w2 <> '' and w3 = ''").select("lang", "w1", "w2", F.col("a").alias("fix2"))
    fixes = heads.join(one, ["lang", "w1"], "left").join(two, ["lang", "w1", "w2"], "left").select("range", "lang", "fix1", "fix2")
    # At most a row for each border and language: as many as the driver has borders.
    fixed = nodes.join(F.broadcast(fixes), ["range", "lang"], "left")
    return fixed.select("lang", "w1", "w2", "w3", "a", F.coalesce("up1", "fix1").alias("up1"), F.coalesce("up2", "fix2").alias("up2")), words


def _key(*columns: str) -> Column:
    """One string of a language and words (no word has a tab)."""
    return F.concat_ws("\t", "lang", *columns)


def candidates(nodes: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, w1, w2, w3) of all phrases of two and three
    words, at their weakest cut."""
    score = "cast(1000000 as decimal(7, 0)) * cast(a as decimal(15, 0)) * cast(a as decimal(15, 0)) div (cast({l} as decimal(19, 0)) * cast({r} as decimal(19, 0)))"
    single = nodes.where("w2 = ''").select(_key("w1").alias("link"), F.col("a").alias("last"))
    pairs = nodes.where("w2 <> '' and w3 = ''").withColumn("link", _key("w2"))
    pairs = stored(hot_safe_join(pairs, single, "link").drop("link"), "pairs")
    tails = pairs.select(_key("w1", "w2").alias("link"), F.col("a").alias("tail"), "last")
    triples = hot_safe_join(nodes.where("w3 <> ''").withColumn("link", _key("w2", "w3")), tails, "link").drop("link")
    two = pairs.select("lang", "w1", "w2", "w3", "a", F.col("up1").alias("l"), F.col("last").alias("r")).withColumn("score", F.expr(score.format(l="l", r="r")))
    three = triples.withColumns({"s1": F.expr(score.format(l="up1", r="tail")), "s2": F.expr(score.format(l="up2", r="last"))})
    later = F.col("s2") < F.col("s1")
    three = three.select("lang", "w1", "w2", "w3", "a", F.when(later, F.col("up2")).otherwise(F.col("up1")).alias("l"), F.when(later, F.col("last")).otherwise(F.col("tail")).alias("r"), F.least("s1", "s2").alias("score"))
    phrase = F.concat_ws(" ", F.filter(F.array("w1", "w2", "w3"), lambda w: w != ""))
    return two.union(three).withColumn("phrase", phrase)


def collocations(docs: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best phrases of each language."""
    nodes, words = frequent_nodes(docs)
    found = stored(candidates(nodes), "candidates")
    longer = found.where("w3 <> ''")
    around = longer.select("lang", "w1", "w2", "a").union(longer.select("lang", "w2", "w3", "a")).groupBy("lang", "w1", "w2").agg(F.max("a").alias("_in"))
    pairs = found.where("w3 = ''").join(around, ["lang", "w1", "w2"], "left").where(F.col("_in").isNull() | (F.col("_in") * 100 < F.col("a") * INSIDE_PERCENT)).drop("_in")
    kept = pairs.select(*found.columns).union(longer)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # A language's best are the best of its parts, in fewer parts at each step.
    best = kept.withColumn("_hash", F.xxhash64("phrase"))
    for parts in RANK_PARTS:
        place = F.row_number().over(Window.partitionBy("lang", F.pmod("_hash", F.lit(parts))).orderBy(*order))
        best = best.withColumn("_r", place).where(F.col("_r") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op11_trie_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of ``documents`` in each language."""
    return collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL = {
    "op11_trie_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
numbered AS (SELECT lang, row_number() OVER () AS id, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
placed AS (SELECT lang, id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM numbered),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM placed WINDOW o AS (PARTITION BY id ORDER BY i)),
f AS (
  SELECT lang, 1 AS k, w1 AS phrase, count(*) AS a, w1, NULL AS w2, NULL AS w3 FROM runs GROUP BY lang, w1
  UNION ALL
  SELECT lang, 2, w1 || ' ' || w2, count(*), w1, w2, NULL FROM runs WHERE w2 IS NOT NULL GROUP BY lang, w1, w2
  UNION ALL
  SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*), w1, w2, w3 FROM runs WHERE w3 IS NOT NULL GROUP BY lang, w1, w2, w3),
total AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
cuts AS (
  SELECT lang, k, phrase, a, 1 AS cut, w1 AS lp, CASE k WHEN 2 THEN w2 ELSE w2 || ' ' || w3 END AS rp FROM f WHERE k >= 2 AND a >= 10
  UNION ALL
  SELECT lang, k, phrase, a, 2, w1 || ' ' || w2, w3 FROM f WHERE k = 3 AND a >= 10),
scored AS (
  SELECT c.lang, c.k, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
weakest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM scored) WHERE o = 1),
around AS (
  SELECT lang, part, max(a) AS most
  FROM (SELECT lang, w1 || ' ' || w2 AS part, a FROM f WHERE k = 3 AND a >= 10 UNION ALL SELECT lang, w2 || ' ' || w3, a FROM f WHERE k = 3 AND a >= 10) GROUP BY lang, part),
kept AS (SELECT w.* FROM weakest w LEFT JOIN around ON around.lang = w.lang AND around.part = w.phrase WHERE w.k = 3 OR most IS NULL OR 100 * most < 50 * w.a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""
}
