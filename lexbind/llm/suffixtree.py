"""Operator 2: language-model scores from a probabilistic suffix tree.

Symbols are the bytes of the lower-cased words, a separator after each word and
an end mark.  Contexts have variable length.  Those of up to DEPTH bytes are any
bytes before the symbol (a word's first HEAD symbols may look back over the
separator into the last TAIL bytes of the word before).  Longer ones reach back
to the start of the word: the separator and all its bytes so far, without limit.
A context is retained if its next-symbol distribution diverges from that of its
longest shorter state (count * KL divergence of at least DIVERGENCE nats and one
for each distinct next symbol, KL of at least MIN_KL, seen twice at least), or if
a longer retained context ends in it.  Distributions are smoothed with the shorter state's distribution (weight:
distinct symbols seen, plus counts that were pruned), down to an add-half
order-0 distribution over bytes.  A symbol's probability is that in the longest
suffix state, and a text's score sums log10 over its symbols.

Data flow
1. One pass cuts each task's texts into blocks of about BLOCK_BYTES and writes,
   per block, its distinct words with training counts and the texts as word
   indices, and, per task, the symbol windows with training counts.
2. Short contexts (up to WINDOW - 1 bytes) are counted from the windows.  They
   and their entries need a share of MIN_CONTEXT and MIN_ENTRY of all symbols, so
   at most WINDOW / MIN_ENTRY entries exist whatever the input: only this part
   is collected and broadcast.
3. Longer contexts have absolute tests only and grow with the corpus.  They stay
   distributed: the vocabulary (all distinct words with counts) is dealt by the
   words' first ANCHOR bytes, and a task walks its sorted words as a trie, which
   gives every word's count and log-probability past its first HEAD symbols.
4. The blocks' words are dealt and sorted alike and pick their answers up there;
   the answers go back to the blocks by (block, word index), where the texts are
   scored.  What a task holds is the vocabulary of one prefix, one chunk of rows,
   or one block.

Edge cases: null and empty texts are the end mark alone; a null id counts as
training; byte 0 counts as byte 1 in short contexts; with no training text the
base score is 0 for V = N = 0 (no denominator) and the tree is uniform; equal
rows score equally; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import drop_stored, fold_of, free_shuffles, release_memory, shuffles_end, small_batches, stored, table

DEPTH, HEAD, TAIL = 4, 3, 3
#: Bytes of a word whose prefix deals it out; contexts of more of them are long.
ANCHOR = 6
#: Symbols of the widest window: separator, ANCHOR - 1 bytes, next symbol.
WINDOW = ANCHOR + 1
BLOCK_BYTES = 8 << 20
#: Rows that a walk of the vocabulary takes together.
CHUNK_ROWS = 150_000
MIN_CONTEXT, MIN_ENTRY = 2e-6, 5e-7
DIVERGENCE, MIN_KL = 4.0, 0.01
STEP, END, START = 0x20, 0x0A, 0x09


# Words as arrays of bytes ---------------------------------------------------


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(word index of every token, bounds of the texts, distinct words)."""
    lower = pc.ascii_lower(texts.fill_null("").cast(pa.large_string()))
    split = pc.ascii_split_whitespace(lower)
    coded = split.flatten().dictionary_encode()
    codes, words = coded.indices.to_numpy(), coded.dictionary
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    empty = pc.index(words, "").as_py() if len(words) else -1
    if empty >= 0:
        real = codes != empty
        bounds = np.concatenate([[0], np.cumsum(real)])[offsets]
        codes = codes[real]
        codes = np.where(codes > empty, codes - 1, codes)
        words = pa.concat_arrays([words[:empty], words[empty + 1 :]])
        return codes, bounds, words
    return codes, offsets.astype(np.int64), words


def _bytes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string array, byte 0 as 1."""
    words = pa.concat_arrays([words.cast(pa.large_binary())])
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = np.frombuffer(words.buffers()[2], np.uint8) if len(words) and words.buffers()[2] else np.zeros(0, np.uint8)
    data = data[offsets[0] : offsets[-1]]
    return np.where(data == 0, 1, data).astype(np.uint8), offsets - offsets[0]


def inner_windows(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, word of each, place in the word) of the symbols from the HEAD-th
    on, packed big-endian: separator, bytes before and symbol while that fits
    into WINDOW bytes, else the last DEPTH bytes before and the symbol."""
    data, bounds = _bytes_of(words)
    n = len(words)
    sizes = np.diff(bounds)
    stream = np.full(len(data) + 2 * n, STEP, np.uint64)
    at = np.arange(len(data)) + 2 * np.repeat(np.arange(n), sizes) + 1
    stream[at] = data
    begins = bounds[:-1] + 2 * np.arange(n)
    counts = np.maximum(0, sizes + 1 - HEAD)
    word = np.repeat(np.arange(n), counts)
    j = HEAD + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    pos = begins[word] + 1 + j
    out = np.zeros(len(pos), np.uint64)
    for back in range(WINDOW - 1, -1, -1):
        ok = back <= DEPTH if back <= DEPTH else (j < ANCHOR) & (j + 1 >= back)
        if ok is True:
            out = (out << np.uint64(8)) | stream[pos - back]
        else:
            out[ok] = (out[ok] << np.uint64(8)) | stream[pos[ok] - back]
    return out, word, j


def edges_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(packed first up to HEAD symbols, packed last up to TAIL bytes) of each word."""
    data, bounds = _bytes_of(words)
    sizes = np.diff(bounds)
    head, tail = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    for k in range(HEAD):
        ok = sizes > k
        head[ok] = (head[ok] << np.uint64(8)) | data[bounds[:-1][ok] + k]
        ok = sizes == k
        head[ok] = (head[ok] << np.uint64(8)) | np.uint64(STEP)
    for k in range(TAIL, 0, -1):
        ok = sizes >= k
        tail[ok] = (tail[ok] << np.uint64(8)) | data[bounds[1:][ok] - k]
    return head, tail


def pair_keys(codes: np.ndarray, bounds: np.ndarray, head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key of every token and end mark: tail of the token before, head; text of each)."""
    n = len(bounds) - 1
    at = np.arange(len(codes)) + np.repeat(np.arange(n), np.diff(bounds))
    heads = np.full(len(codes) + n, END, np.uint64)
    heads[at] = head[codes]
    tails = np.full(len(codes) + n, START, np.uint64)
    after = at + 1
    tails[after] = tail[codes]
    # What follows an end mark starts a text.
    ends = bounds[1:] + np.arange(n)
    tails[ends[:-1] + 1] = START
    if n:
        tails[0] = START
    return (tails << np.uint64(24)) | heads, np.repeat(np.arange(n), np.diff(bounds) + 1)


def pair_windows(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows, key of each) of the head symbols of pair keys."""
    tail, head = keys >> np.uint64(24), keys & np.uint64(0xFFFFFF)
    size = 1 + (head > 0xFF).astype(np.int64) + (head > 0xFFFF)
    context = (tail << np.uint64(8)) | np.uint64(STEP)
    out, which = [], []
    for j in range(HEAD):
        ok = np.flatnonzero(size > j)
        left = head[ok] >> (np.uint64(8) * (size[ok] - 1 - j).astype(np.uint64))
        out.append(((context[ok] << np.uint64(8 * (j + 1))) | left) & np.uint64((1 << 8 * (DEPTH + 1)) - 1))
        which.append(ok)
    return np.concatenate(out), np.concatenate(which)


# The tree -------------------------------------------------------------------


class Tree:
    """Retained contexts by length with their next-symbol counts."""

    def __init__(self, total: int, roots: np.ndarray):
        self.root = (roots + 0.5) / (total + 0.5 * 256)
        #: length -> (contexts, denominator, parent weight, entry keys, entry counts)
        self.levels: dict[int, tuple] = {}

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """P(last byte | bytes before it) of packed windows."""
        symbol = (windows & np.uint64(0xFF)).astype(np.int64)
        context = windows >> np.uint64(8)
        p = self.root[symbol]
        for length in sorted(self.levels):
            contexts, denominator, weight, keys, counts = self.levels[length]
            if not len(contexts):
                continue
            mask = np.uint64((1 << 8 * length) - 1)
            long_enough = (context >> np.uint64(8 * (length - 1))) > 0
            rows = np.flatnonzero(long_enough)
            ctx = context[rows] & mask
            at = np.minimum(np.searchsorted(contexts, ctx), len(contexts) - 1)
            hit = contexts[at] == ctx
            rows, at, ctx = rows[hit], at[hit], ctx[hit]
            key = (ctx << np.uint64(8)) | symbol[rows].astype(np.uint64)
            c = np.zeros(len(rows))
            if len(keys):
                k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                c = np.where(keys[k] == key, counts[k], 0.0)
            p[rows] = (c + weight[at] * p[rows]) / denominator[at]
        return p


def build_tree(total: int, contexts: dict[int, tuple], entries: dict[int, tuple]) -> Tree:
    """Tree from counts.  ``contexts[length]``: (keys, counts, distinct next
    symbols); ``entries[length]``: (keys with the next symbol, counts); length 0
    of ``entries`` has the symbols themselves.  All sorted by key."""
    roots = np.zeros(256)
    if 0 in entries:
        roots[entries[0][0].astype(np.int64)] = entries[0][1]
    tree = Tree(total, roots)
    needed = np.zeros(0, np.uint64)  # suffixes of retained contexts
    full = Tree(total, roots)
    gains: dict[int, np.ndarray] = {}
    for length in range(1, WINDOW):
        keys, counts, distinct = contexts.get(length, (np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)))
        ekeys, ecounts = entries.get(length, (np.zeros(0, np.uint64), np.zeros(0)))
        at = np.minimum(np.searchsorted(keys, ekeys >> np.uint64(8)), max(0, len(keys) - 1))
        own = (keys[at] == ekeys >> np.uint64(8)) if len(keys) else np.zeros(len(ekeys), bool)
        ekeys, ecounts, at = ekeys[own], ecounts[own], at[own]
        seen = np.bincount(at, ecounts, len(keys))
        weight = distinct + np.maximum(0, counts - seen)
        # Divergence from the suffix's smoothed distribution, over the symbols seen.
        p = ecounts / counts[at]
        q = full.probabilities(ekeys)
        kl = np.bincount(at, p * np.log(p / q), len(keys))
        gains[length] = (kl >= MIN_KL) & (kl * counts >= DIVERGENCE + distinct)
        full.levels[length] = (keys, seen + weight, weight, ekeys, ecounts)
    for length in range(WINDOW - 1, 0, -1):
        keys, denominator, weight, ekeys, ecounts = full.levels[length]
        mine = gains[length] | (np.isin(keys, needed) if length <= DEPTH else False)
        kept = keys[mine]
        suffix = np.uint64((1 << 8 * min(length - 1, DEPTH)) - 1)
        needed = np.union1d(needed if length > DEPTH else np.zeros(0, np.uint64), kept & suffix)
        own = np.isin(ekeys >> np.uint64(8), kept)
        tree.levels[length] = (kept, denominator[mine], weight[mine], ekeys[own], ecounts[own])
    return tree


def spell(words: pa.Array, counts: np.ndarray, tree: Tree) -> np.ndarray:
    """log10 probability of each word past its first HEAD symbols, separator
    included.  ``words``: distinct, sorted, and all words of their prefixes of
    ANCHOR bytes; ``counts``: their training counts."""
    n = len(words)
    windows, word, place = inner_windows(words)
    distinct, back = np.unique(windows, return_inverse=True)
    p = tree.probabilities(distinct)[back]
    del distinct, back, windows
    plain = pa.concat_arrays([words.cast(pa.large_binary())])
    bounds = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(plain.buffers()[2], np.uint8) if n and plain.buffers()[2] else np.zeros(0, np.uint8)
    sizes = np.diff(bounds)
    # Bytes shared with the word before.
    shared = np.zeros(n + 1, np.int64)
    at, m = np.arange(1, n), 0
    while len(at):
        at = at[(sizes[at] > m) & (sizes[at - 1] > m)]
        at = at[data[bounds[at] + m] == data[bounds[at - 1] + m]]
        shared[at] += 1
        m += 1
    fork = np.maximum(shared[:-1], shared[1:])
    # Where no other word shares the context, its word's symbol is all it has.
    alone = (place >= ANCHOR) & (place > fork[word])
    q, c = p[alone], counts[word[alone]]
    gain = -np.log(q)
    kept = (c >= 2) & (gain >= MIN_KL) & (c * gain >= DIVERGENCE + 1)
    p[alone] = np.where(kept, (c + q) / (c + 1), q)
    offset = np.cumsum(np.maximum(0, sizes + 1 - HEAD)) - np.maximum(0, sizes + 1 - HEAD)
    live = np.flatnonzero(fork >= ANCHOR)
    m = ANCHOR
    while len(live := live[(fork[live] >= m) & (sizes[live] >= m)]):
        first = shared[live] < m
        context = np.cumsum(first) - 1
        branch = np.cumsum(shared[live] < m + 1) - 1
        lead = np.flatnonzero(shared[live] < m + 1)
        flat = offset[live] + m - HEAD
        own, q = context[lead], p[flat[lead]]
        total = np.bincount(context, counts[live])
        seen = np.bincount(branch, counts[live])
        weight = np.bincount(own, seen > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            r = seen / total[own]
            kl = np.bincount(own, np.where(seen > 0, r * np.log(r / q), 0.0))
            kept = ((total >= 2) & (kl >= MIN_KL) & (kl * total >= DIVERGENCE + weight))[own]
            smooth = np.where(kept, (seen + weight[own] * q) / (total + weight)[own], q)
        p[flat] = smooth[branch]
        m += 1
    return np.bincount(word, np.log10(p), n)


# Passes ---------------------------------------------------------------------


def _compress(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(raw)


def _expand(raw: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(raw)


BLOCKS = "kind int, block long, idx int, word binary, win long, n long, doc_id long, held_out boolean, payload binary"


def count_blocks(docs: DataFrame) -> DataFrame:
    """Stored table of blocks.  Kinds: 0 a text, 1 a word, 2 a window, 3 a block's words."""
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
    names = ["kind", "block", "idx", "word", "win", "n", "doc_id", "held_out", "payload"]

    def rows_of(rows: int, block: int, kind: int, **columns) -> pa.RecordBatch:
        columns |= {"kind": pa.array(np.full(rows, kind, np.int32)), "block": pa.array(np.full(rows, block, np.int64))}
        return pa.RecordBatch.from_arrays([columns.get(c) if c in columns else pa.nulls(rows, k) for c, k in zip(names, kinds)], names)

    def merge(windows: list, wins: np.ndarray, n: np.ndarray) -> None:
        """Add window counts to the task's sorted distinct ones."""
        if windows:
            wins, n = np.concatenate([windows[0], wins]), np.concatenate([windows[1], n])
        order = np.argsort(wins)
        wins, n = wins[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], wins[1:] != wins[:-1]])) if len(wins) else np.zeros(0, np.int64)
        windows[:] = [wins[first], np.add.reduceat(n, first) if len(first) else n]

    def one(block: int, ids: list, held: list, texts: pa.Array, windows: list) -> Iterator[pa.RecordBatch]:
        codes, bounds, words = split_words(texts)
        held_out = np.array(held, bool)
        sizes = np.diff(bounds)
        train = np.repeat(~held_out, sizes)
        counts = np.bincount(codes[train], minlength=len(words))
        head, tail = edges_of(words)
        keys, owner = pair_keys(codes, bounds, head, tail)
        pairs, pair_n = np.unique(keys[~held_out[owner]], return_counts=True)
        del keys, owner
        inner, word, _ = inner_windows(words)
        weights = counts[word]
        cross, pair = pair_windows(pairs)
        merge(windows, np.concatenate([inner[weights > 0], cross]), np.concatenate([weights[weights > 0], pair_n[pair]]))
        yield rows_of(len(words), block, 1, idx=pa.array(np.arange(len(words), dtype=np.int32)), word=words.cast(pa.binary()), n=pa.array(counts.astype(np.int64)))
        packed = [_compress(codes[a:b].astype("<u4").tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        yield rows_of(len(ids), block, 0, n=pa.array(sizes.astype(np.int64)), doc_id=pa.array(ids, pa.int64()), held_out=pa.array(held, pa.bool_()), payload=pa.array(packed, pa.binary()))
        blob = head.astype("<u4").tobytes() + tail.astype("<u4").tobytes()
        yield rows_of(1, block, 3, n=pa.array([len(words)]), payload=pa.array([_compress(blob)], pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, held_rows, size = TaskContext.get().partitionId(), 0, [], 0
        windows: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held_rows.append(batch)
                size += batch.column(2).nbytes
            if size >= BLOCK_BYTES:
                yield from flush((part << 32) + seq, held_rows, windows)
                seq, held_rows, size = seq + 1, [], 0
        if held_rows:
            yield from flush((part << 32) + seq, held_rows, windows)

        if windows:
            for lo in range(0, len(windows[0]), 500_000):
                wins, n = (x[lo : lo + 500_000] for x in windows)
                yield rows_of(len(wins), part << 32, 2, win=pa.array(wins.astype(np.int64)), n=pa.array(n.astype(np.int64)))
        del windows
        release_memory()

    def flush(block: int, batches: list[pa.RecordBatch], windows: list) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(batches).combine_chunks()
        texts = whole.column(2).combine_chunks()
        texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
        yield from one(block, whole.column(0).to_pylist(), whole.column(1).to_pylist(), texts, windows)

    small_batches(docs.sparkSession)
    held = F.coalesce(fold_of() % 10 == 0, F.lit(False))
    inputs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return stored(inputs.mapInArrow(run, BLOCKS), "blocks")


def fit_tree(blocks: DataFrame) -> Tree:
    """The short contexts, from all windows of the blocks."""
    wins = blocks.where("kind = 2").groupBy("win").agg(F.sum("n").alias("n"))
    wins = stored(wins, "windows")
    # Every window is counted once at its own symbol; shorter contexts by masking.
    total = wins.agg(F.sum("n")).first()[0] or 0
    levels = range(WINDOW)
    grams = wins.select("win", "n", F.explode(F.array(*map(F.lit, levels))).alias("length"))
    mask = F.element_at(F.array(*[F.lit((1 << 8 * (k + 1)) - 1).cast("long") for k in levels]), F.col("length") + 1)
    top = F.call_function("shiftrightunsigned", F.col("win"), F.col("length") * 8)
    # Contexts of more than DEPTH bytes are whole windows from a word's start.
    grams = grams.where((F.col("length") == 0) | ((F.col("length") <= DEPTH) & (top > 0)) | (top.between(1, 255)))
    grams = grams.groupBy("length", F.col("win").bitwiseAND(mask).alias("key")).agg(F.sum("n").alias("n"))
    grams = stored(grams, "grams")
    entries = grams.where(F.col("n") >= math.ceil(MIN_ENTRY * total)).toArrow()
    ctx = grams.where("length > 0").groupBy("length", F.shiftright("key", 8).alias("key")).agg(F.sum("n").alias("n"), F.count("*").alias("kinds"))
    ctx = ctx.where(F.col("n") >= max(2, math.ceil(MIN_CONTEXT * total))).toArrow()
    drop_stored(wins)
    drop_stored(grams)

    def by_length(frame, *columns):
        out = {}
        lengths, all_keys = frame.column("length").to_numpy(), frame.column("key").to_numpy().astype(np.uint64)
        values = [frame.column(c).to_numpy().astype(float) for c in columns]
        for length in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths == length)
            rows = rows[np.argsort(all_keys[rows])]
            out[length] = (all_keys[rows], *(v[rows] for v in values))
        return out

    return build_tree(total, by_length(ctx, "n", "kinds"), by_length(entries, "n"))


def answers_of(words: DataFrame, vocabulary: DataFrame, tree: Tree, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(asker, found) with idx, training count and :func:`spell` of every (block,
    idx, word) of ``words``, packed by asker as far as a chunk has them together.

    Rows of a prefix arrive vocabulary first, so a task holds the vocabulary of
    one prefix at a time and passes the askers through.
    """
    known = vocabulary.select("word", F.lit(0).alias("asks"), F.col("c").alias("n"), F.lit(0).alias("idx"))
    asked = words.select("word", F.lit(1).alias("asks"), F.col("block").alias("n"), "idx")
    prefix = F.substring("word", 1, ANCHOR)
    dealt = known.union(asked).repartition(prefix).sortWithinPartitions(prefix, "asks", "word")
    shared = words.sparkSession.sparkContext.broadcast(tree)  # at most WINDOW / MIN_ENTRY entries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        open_: tuple | None = None  # the vocabulary of a prefix whose rows go on

        def take(part: pa.Table, goes_on: bool) -> pa.RecordBatch:
            nonlocal open_
            asks = part.column("asks").to_numpy() == 1
            mine = part.filter(pa.array(~asks))
            lexicon = mine.column("word").combine_chunks(), mine.column("n").to_numpy()
            lexicon = (*lexicon, spell(lexicon[0], lexicon[1].astype(float), shared.value))
            if open_ is not None:
                lexicon = pa.concat_arrays([open_[0], lexicon[0]]), *(np.concatenate(x) for x in zip(open_[1:], lexicon[1:]))
            which = part.filter(pa.array(asks))
            at = pc.index_in(which.column("word").combine_chunks(), lexicon[0]).to_numpy(zero_copy_only=False)
            open_ = lexicon if goes_on else None
            askers, idx, c, logp = which.column("n").to_numpy(), which.column("idx").to_numpy(), lexicon[1][at], lexicon[2][at]
            order = np.lexsort((idx, askers))
            cuts = np.flatnonzero(np.concatenate([[True], np.diff(askers[order]) != 0, [True]])) if len(order) else np.zeros(1, np.int64)
            packed = [_compress(idx[r].astype("<u4").tobytes() + c[r].astype("<i8").tobytes() + logp[r].astype("<f8").tobytes()) for r in (order[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
            return pa.RecordBatch.from_arrays([pa.array(askers[order[cuts[:-1]]], pa.int64()), pa.array(packed, pa.binary())], ["asker", "found"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < chunk_rows:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            starts = pc.binary_slice(whole.column("word"), 0, ANCHOR).combine_chunks()
            last = starts[len(starts) - 1]
            cut = pc.index(starts, last).as_py()
            if cut:
                yield take(whole.slice(0, cut), False)
            rest = whole.slice(cut)
            if rest.num_rows >= chunk_rows and rest.column("asks")[rest.num_rows - 1].as_py() == 1:
                yield take(rest, True)
                rest = rest.slice(rest.num_rows)
            held, rows = rest.to_batches(), rest.num_rows
        if rows:
            yield take(pa.Table.from_batches(held).combine_chunks(), False)
        del held, open_
        release_memory()

    small_batches(words.sparkSession, 10_000)
    return stored(dealt.mapInArrow(run, "asker long, found binary"), "answers")


def score_blocks(blocks: DataFrame, tree: Tree, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Scores of every text of the blocks."""
    spark = blocks.sparkSession
    words = blocks.where("kind = 1").select("block", "idx", "word", "n")
    vocabulary = stored(words.groupBy("word").agg(F.sum("n").alias("c")), "vocabulary")
    free_shuffles(spark)
    sums = vocabulary.where("c > 0").agg(F.sum("c"), F.count("*")).first()
    ends = blocks.where("kind = 0 and not held_out").count()
    all_n, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    answers = answers_of(words, vocabulary, tree, chunk_rows)
    drop_stored(vocabulary)
    free_shuffles(spark)
    shared = spark.sparkContext.broadcast(tree)

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        model = shared.value
        kind = texts.column("kind").to_numpy()
        payloads = texts.column("payload")
        at = int(np.flatnonzero(kind == 3)[0])
        n = texts.column("n")[at].as_py()
        edges = np.frombuffer(_expand(payloads[at].as_py()), "<u4").astype(np.uint64)
        head, tail = edges[:n], edges[n:]
        c, inner = np.zeros(n), np.zeros(n)
        for packed in found.column("found"):
            raw = _expand(packed.as_py())
            m = len(raw) // 20
            idx = np.frombuffer(raw, "<u4", m)
            c[idx], inner[idx] = np.frombuffer(raw, "<i8", m, 4 * m), np.frombuffer(raw, "<f8", m, 12 * m)
        scale = all_n + 0.1 * (distinct + 1)
        base_of = np.log10((c + 0.1) / scale) if all_n else np.zeros(n)
        end_base = math.log10((ends + 0.1) / scale) if all_n else 0.0
        rows = np.flatnonzero(kind == 0)
        codes = [np.frombuffer(_expand(payloads[r].as_py()), "<u4") for r in rows.tolist()]
        lengths = np.array([len(x) for x in codes], np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        flat = np.concatenate(codes).astype(np.int32) if codes else np.zeros(0, np.int32)
        del codes
        text_of = np.repeat(np.arange(len(rows)), lengths)
        base = np.bincount(text_of, base_of[flat], len(rows)) + end_base
        score_ = np.bincount(text_of, inner[flat], len(rows))
        known = np.bincount(text_of, c[flat] > 0, len(rows)).astype(np.int64) + (ends > 0)
        del text_of
        keys, owner = pair_keys(flat, bounds, head, tail)
        del flat
        pairs, pair_of = np.unique(keys, return_inverse=True)
        del keys
        wins, which = pair_windows(pairs)
        pair_score = np.bincount(which, np.log10(model.probabilities(wins)), len(pairs))
        score_ += np.bincount(owner, pair_score[pair_of], len(rows))
        del pair_of, owner
        kept = texts.select(["doc_id", "held_out"]).take(pa.array(rows))
        release_memory()
        return pa.table([kept.column("doc_id"), kept.column("held_out"), pa.array(lengths + 1), pa.array(known), pa.array(np.full(len(rows), all_n)), pa.array(base), pa.array(score_)], names=OUT)

    OUT = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    texts = blocks.where("kind in (0, 3)").select("block", "kind", "n", "doc_id", "held_out", "payload")
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return texts.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(score, schema)


def op2_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score all whole ``documents``."""
    with shuffles_end(spark):
        blocks = count_blocks(table(spark, sf_dir, "documents"))
        return score_blocks(blocks, fit_tree(blocks))
