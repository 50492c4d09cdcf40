"""Operator 13: spelling variants by Aho-Corasick automata over halves of words.

1. Every task counts the distorted runs of its texts; counts of equal words are added
   up, and words of ``LONGEST_EDIT`` code points and ``LEAST`` occurrences stay.
2. One edit leaves one half of a word whole.  Automaton shards hold both halves of
   every word; a word that is scanned meets the halves that occur in it.  A left half
   counts only at offset 0, a right half only at the end, and only if the lengths
   differ by one at most; then the distance is verified.  The right half's find is
   skipped where the left half fits too, so a pair is found once.
3. Words go to groups by the three code points at the outer end of the half and the
   word's length (a half has three at least); a word is scanned by the shards that
   hold the groups of its own ends and the three lengths that fit.  Small groups share
   a shard; those of over ``SHARD_WORDS`` words are split, and so are the words that
   they scan, so no task depends on how common an end is.
4. A word's form is its most frequent near word; roots follow forms by pointer jumping.

Within a shard finds of one half are looked up by what else must agree: of the other
half, with one edit, the outer or the inner part is whole as well.

Edge cases: null and empty texts have no words; a null doc_id counts as empty text in
the hash; a text of any length is one count; equal rows count each (their hashes are
equal); an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import drop_stored, free_shuffles, hot_safe_join, release_memory, small_batches, stored, table

#: A run that the hash selects loses a letter; length and count of words; share of a form.
MODULUS, SHORTEST, LEAST, TIMES = 199, 6, 5, 5
#: Code points of an end that routes a half to its shard.
END = 3
#: Words of a shard, and words that it scans in one task.
SHARD_WORDS = 20_000
#: Distinct words, and characters of them, that a task counts before it hands them on.
HELD_WORDS, HELD_CHARS = 1_000_000, 32_000_000

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
RUN = re.compile("[A-Za-zÀ-ÿ]+")


def distorted(doc_id: int | None, text: bytes) -> dict[str, int]:
    """Occurrences of each word of a text, after deletions."""
    runs: dict[str, int] = {}
    for run in RUN.findall(text.translate(_LOWER).decode()):
        runs[run] = runs.get(run, 0) + 1
    start = zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode()))
    out: dict[str, int] = {}
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), start)
        if h % MODULUS == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        out[run] = out.get(run, 0) + n
    return out


def words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words long and frequent enough."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}
        chars = 0

        def flush() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for word, n in distorted(doc_id, text.as_py() or b"").items():
                    if len(word) >= SHORTEST:
                        if word not in held:
                            held[word], chars = 0, chars + len(word)
                        held[word] += n
                if len(held) >= HELD_WORDS or chars >= HELD_CHARS:
                    yield flush()
                    chars = 0
        yield flush()
        release_memory()

    small_batches(docs.sparkSession)
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(rows, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST)


def one_edit(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k:] == b[k + 1 :]


class Automaton:
    """One shard: halves of words with the words that have them."""

    def __init__(self, halves: list[tuple[str, str]]):
        """``halves`` are (side, word)."""
        import ahocorasick

        self.machine = ahocorasick.Automaton()
        held: dict[str, dict] = {}
        for side, w in halves:
            cut = len(w) // 2
            half, rest = (w[:cut], w[cut:]) if side == "left" else (w[cut:], w[:cut])
            # One edit in the rest leaves its first or its last part whole.
            middle = len(rest) // 2
            known = held.setdefault(half, {}).setdefault(side, defaultdict(list))
            known["first", middle, rest[:middle]].append(w)
            known["last", len(rest) - middle, rest[middle:]].append(w)
        for half, sides in held.items():
            self.machine.add_word(half, (len(half), {side: (known, {k[:2] for k in known}) for side, known in sides.items()}))
        self.machine.make_automaton()

    def near(self, word: str) -> set[str]:
        """Words of the shard at distance one, each reported by one of its halves."""
        out = set()
        for end, (size, sides) in self.machine.iter(word):
            for side, (known, parts) in sides.items():
                if end + 1 != (size if side == "left" else len(word)):
                    continue
                rest = word[size:] if side == "left" else word[: len(word) - size]
                for part, n in parts:
                    if n <= len(rest):
                        for w in known.get((part, n, rest[:n] if part == "first" else rest[len(rest) - n :]), ()):
                            if w not in out and one_edit(word, w) and (side == "left" or not word.startswith(w[: len(w) // 2])):
                                out.add(w)
        return out


def near_words(vocabulary: DataFrame) -> DataFrame:
    """Ordered pairs (word, near) of words at distance one, each once."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.substring("word", at, END).alias("end")) for s, at in (("left", 1), ("right", -END))])
    ended = vocabulary.select("word", F.length("word").alias("size"), F.explode(sides).alias("e"))
    group = F.concat_ws(":", F.col("e.side"), F.col("e.end"), F.col("size"))
    held = ended.select("word", F.col("e.side").alias("side"), group.alias("group"))
    asked = ended.select("word", "e", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size")).select("word", F.lit(None).cast("string").alias("side"), group.alias("group"))
    # Groups of words by an end and a length: few together in a pool, large ones split.
    plan = held.groupBy("group").agg(F.count("*").alias("c")).join(asked.groupBy("group").agg(F.count("*").alias("asks")), "group")
    plan = stored(plan.withColumns({"parts": F.ceil(F.col("c") / SHARD_WORDS), "blocks": F.ceil(F.col("asks") / SHARD_WORDS)}), "plan")
    pools = -(-(plan.agg(F.sum(F.col("c") + F.col("asks"))).first()[0] or 0) // SHARD_WORDS)
    alone = (F.col("parts") > 1) | (F.col("blocks") > 1)
    pool = F.pmod(F.xxhash64("group"), F.lit(max(1, pools))).cast("string")
    plan = plan.select("group", F.when(alone, F.col("group")).otherwise(pool).alias("shard"), "parts", "blocks", "c", "asks")

    def dealt(rows: DataFrame, own: str, other: str, count: str) -> DataFrame:
        """Every row at one of its own side's places and all of the other's."""
        joined = hot_safe_join(rows, plan, "group", count=count)
        mine = F.pmod(F.xxhash64("word"), F.col(own)).alias(own)
        return joined.select("shard", mine, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias(other), "side", "word").select("shard", "parts", "blocks", "side", "word")

    rows = dealt(held, "parts", "blocks", "c").union(dealt(asked, "blocks", "parts", "asks"))

    def scan(shard: pa.Table) -> pa.Table:
        sides, held_words = shard.column("side").to_pylist(), shard.column("word").to_pylist()
        machine = Automaton([(s, w) for s, w in zip(sides, held_words) if s])
        found = [(w, near) for w in {w for s, w in zip(sides, held_words) if not s} for near in machine.near(w)]
        return pa.table([pa.array([p[k] for p in found], pa.string()) for k in (0, 1)], names=["word", "near"])

    return rows.groupBy("shard", "parts", "blocks").applyInArrow(scan, "word string, near string")


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    spark = docs.sparkSession
    vocabulary = stored(words(docs), "vocabulary")
    pairs = stored(near_words(vocabulary), "near")
    free_shuffles(spark)
    counts = vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("word"))).alias("best")
    known = pairs.join(counts, "near").groupBy("word").agg(F.count("*").alias("n_near"), best)
    rows = vocabulary.join(known, "word", "left")
    big = -F.col("best.less") >= TIMES * F.col("n")
    rows = rows.select("word", F.when(big, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(big, -F.col("best.less")).alias("form_n"))
    rows = stored(rows, "forms")
    drop_stored(pairs)
    drop_stored(vocabulary)
    # A form has at least TIMES the occurrences, so chains are short and end.
    roots = rows.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ups = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = stored(hot_safe_join(roots, ups, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if roots.where("moved").isEmpty():
            break
        roots = roots.select("word", "root")
    out = rows.join(roots.select("word", "root"), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants among the words of ``documents``."""
    return variants(table(spark, sf_dir, "documents"))
