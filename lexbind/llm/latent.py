"""Operator 7: benchmark decontamination by latent semantic retrieval.

1. Terms are the words of the benchmark items (lower-cased, outer punctuation
   off).  Their document frequencies are counted over all documents; every term
   weighs at least FLOOR, however common it is.
2. TF-IDF passages (the items, and the 64-word passages of all documents) are
   factored by a distributed randomised SVD: tasks return partial products with a
   random test matrix (terms x RANK), so what meets is bounded by the benchmark, not
   by the documents.
3. Every document is cut into overlapping passages; each is projected and
   compared with all items by cosine, whose lengths are those of the whole
   passage and item, words outside the benchmark included (one matrix product
   for a block of passages).  Apart from that, every run of RUN words that an item has makes its
   place a candidate, so that copies are found however common their words are;
   items of MANY_RUNS words or more need two such runs near each other.
4. Candidates are confirmed word by word: longest common subsequence with the
   item, and for looser matches (paraphrases) the share of the item's answer
   terms (its rarest) that the passage holds.  Items of fewer than MIN_ITEM words
   must appear as a phrase.

Items are searched in blocks of ITEM_BLOCK, each against all documents; every row
passes through all blocks, so rows are never matched up by id.  The DENSE most
frequent terms enter a passage by a matrix product, the others by lookup; both
give the same sums.

Edge cases: null and empty texts and items match nothing; repeated items match
alike and are all listed; items without an id are searched like any other and mark
a row as contaminated, but stand in no list; rows with equal or null ids are judged one by one; texts
of any length are read whole; a table without benchmark words or documents gives
no match; extra columns are ignored or kept as asked, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import release_memory, small_batches, table

ITEM_BLOCK = 5000
RANK, OVERSAMPLE = 64, 8
#: Passages: CHUNKS chunks of STRIDE words, starting at every chunk.
STRIDE, CHUNKS = 16, 4
#: Least weight of a term.
FLOOR = 0.1
#: Most frequent terms, which enter passages by a matrix product.
DENSE = 128
#: Chunks that are projected together.
PART = 4096
#: Words of the runs that are looked up exactly (whole items where shorter).
RUN = 3
#: Items of so many words need two of their runs (a copy that lost 30 % of 20 words
#: at random keeps six on average).
MANY_RUNS = 20
COSINE = 0.15
#: Share of an item's words in the common subsequence: alone, and with the answer terms.
COPIED, REPHRASED, ANSWERS = 0.7, 0.45, 0.6
MIN_ITEM = 8
#: Share of an item's terms, rarest first, that count as its answer (at least 3).
ANSWER_SHARE = 0.3
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”‘’…"


def _terms(words: pa.Array) -> pa.Array:
    return pc.utf8_trim(pc.utf8_lower(words), characters=MARKS)


def terms_of(text: str) -> list[str]:
    words = pc.ascii_split_whitespace(pa.array([text], pa.large_string())).flatten()
    return [t for t in _terms(words).to_pylist() if t]


def _coded(texts: pa.Array, index: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term id of every word, -1 outside the benchmark, bounds of the texts);
    words of nothing but punctuation are dropped."""
    split = pc.ascii_split_whitespace(texts.fill_null("").cast(pa.large_string()))
    words = split.flatten().dictionary_encode()
    terms = _terms(words.dictionary)
    ids = pc.index_in(terms, index).fill_null(-1).to_numpy(zero_copy_only=False)
    ids = np.where(pc.binary_length(terms).to_numpy() == 0, -2, ids).astype(np.int32)
    codes = ids[words.indices.to_numpy()]
    offsets = split.offsets.to_numpy()
    real = codes > -2
    bounds = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    return codes[real], bounds


class Items:
    """A block of benchmark items with their terms and weights."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.ids = [i for i, _ in rows]
        seen: dict[str, int] = {}
        self.codes = [np.array([seen.setdefault(t, len(seen)) for t in ts], np.int32) for _, ts in rows]
        self.index = pa.array(list(seen), pa.large_string())

    def weigh(self, df: np.ndarray, documents: int) -> None:
        self.documents = documents
        self.weight = np.maximum(np.log((documents + 1) / (df + 1)), FLOOR).astype(np.float32)
        self.dense = np.sort(np.argsort(-df, kind="stable")[:DENSE])
        self.answers, terms, values = [], [], []
        for codes in self.codes:
            kinds, n = np.unique(codes, return_counts=True)
            order = kinds[np.argsort(-self.weight[kinds], kind="stable")]
            self.answers.append(set(order[: max(3, math.ceil(ANSWER_SHARE * len(kinds)))].tolist()))
            tf = n * self.weight[kinds].astype(np.float64)
            terms.append(kinds)
            values.append(tf / np.linalg.norm(tf))
        #: TF-IDF rows of the items, unit length: terms, values, first entry of each item.
        self.terms, self.values = np.concatenate(terms), np.concatenate(values)
        self.firsts = np.concatenate([[0], np.cumsum([len(t) for t in terms])])

    def times(self, right: np.ndarray) -> np.ndarray:
        """TF-IDF rows of the items @ right."""
        out = np.zeros((len(self.codes), right.shape[1]))
        for lo in range(0, len(out), 1000):
            cut = self.firsts[lo : lo + 1001]
            part = slice(cut[0], cut[-1])
            out[lo : lo + 1000] = np.add.reduceat(self.values[part, None] * right[self.terms[part]], cut[:-1] - cut[0])
        return out

    def spread(self, left: np.ndarray) -> np.ndarray:
        """TF-IDF rows of the items, transposed, @ left."""
        out = np.zeros((len(self.index), left.shape[1]))
        for item, (a, b) in enumerate(zip(self.firsts[:-1], self.firsts[1:])):
            out[self.terms[a:b]] += self.values[a:b, None] * left[item]
        return out


class Runs:
    """The items' runs of RUN words by hash: where a text has one, and of which
    items.  Equal hashes of other runs only make candidates that are not confirmed."""

    BITS = 20

    def __init__(self, codes: list[np.ndarray]):
        self.tables = []
        for n in sorted({min(RUN, len(c)) for c in codes}):
            own = [(i, self._hashes(c, n)) for i, c in enumerate(codes) if min(RUN, len(c)) == n]
            hashes = np.concatenate([h for _, h in own])
            item = np.concatenate([np.full(len(h), i, np.int64) for i, h in own])
            offset = np.concatenate([np.arange(len(h)) for _, h in own])
            order = np.argsort(hashes, kind="stable")
            known = np.zeros(1 << self.BITS, bool)
            known[hashes >> np.uint64(64 - self.BITS)] = True
            self.tables.append((n, known, hashes[order], item[order], offset[order]))

    @staticmethod
    def _hashes(codes: np.ndarray, n: int) -> np.ndarray:
        out = np.zeros(max(0, len(codes) - n + 1), np.uint64)
        for k in range(n):
            out = (out + codes[k : k + len(out)].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        return out * np.uint64(0xBF58476D1CE4E5B9)

    def find(self, codes: np.ndarray, token_doc: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, word where the item would start, item) of every run of an item."""
        outside = np.concatenate([[0], np.cumsum(codes < 0)])
        docs, starts, items = [], [], []
        for n, known, hashes, item, offset in self.tables:
            m = max(0, len(codes) - n + 1)
            at = np.flatnonzero((outside[n : n + m] == outside[:m]) & (token_doc[:m] == token_doc[n - 1 : n - 1 + m]))
            h = self._hashes(codes, n)[at]
            maybe = known[h >> np.uint64(64 - self.BITS)]
            at, h = at[maybe], h[maybe]
            lo = np.searchsorted(hashes, h, "left")
            many = np.searchsorted(hashes, h, "right") - lo
            entry = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
            at = np.repeat(at, many)
            docs.append(token_doc[at])
            starts.append(np.maximum(bounds[token_doc[at]], at - offset[entry]))
            items.append(item[entry])
        return np.concatenate(docs), np.concatenate(starts), np.concatenate(items)


class Sieve:
    """Upper bounds that candidates must pass before they are compared in order:
    the words in common with the item, as a bag, and its answer terms."""

    #: Words of passages that are looked at together.
    WORDS = 1 << 20

    def __init__(self, items: Items):
        self.width = len(items.index)
        self.sizes = np.array([len(c) for c in items.codes])
        # Which words an item has, a bit each, and how often and whether as an answer.
        self.bits = np.zeros((len(items.codes), self.width // 8 + 1), np.uint8)
        keys, times, answer = [], [], []
        for item, codes in enumerate(items.codes):
            kinds, n = np.unique(codes, return_counts=True)
            np.bitwise_or.at(self.bits[item], kinds >> 3, (1 << (kinds & 7)).astype(np.uint8))
            keys.append(item * self.width + kinds)
            times.append(n)
            answer.append(np.isin(kinds, list(items.answers[item])))
        self.keys, self.times, self.answer = np.concatenate(keys), np.concatenate(times), np.concatenate(answer)
        self.wanted = ANSWERS * np.array([len(a) for a in items.answers])

    def passes(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Whether ``codes[begin:end]`` may be confirmed for each item."""
        out = np.zeros(len(item), bool)
        cuts = np.searchsorted(np.cumsum(end - begin), np.arange(0, int((end - begin).sum()) + self.WORDS, self.WORDS))
        for lo, hi in zip(cuts[:-1], np.maximum(cuts[1:], 1)):
            if lo < hi:
                out[lo:hi] = self._part(codes, begin[lo:hi], end[lo:hi], item[lo:hi])
        return out

    def _part(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
        n = end - begin
        owner = np.repeat(np.arange(len(n)), n)
        words = codes[np.arange(len(owner)) + np.repeat(begin - np.cumsum(n) + n, n)]
        size = self.sizes[item]
        short = size < MIN_ITEM
        held = np.flatnonzero(words >= 0)
        owner, words = owner[held], words[held]
        inside = (self.bits[item[owner], words >> 3] >> (words & 7).astype(np.uint8)) & 1 > 0
        owner, words = owner[inside], words[inside]
        enough = np.bincount(owner, minlength=len(n)) >= REPHRASED * size
        some = enough[owner] & ~short[owner]
        pair, times = np.unique(owner[some] * self.width + words[some], return_counts=True)
        owner = pair // self.width
        at = np.searchsorted(self.keys, item[owner] * self.width + pair % self.width)
        bag = np.bincount(owner, np.minimum(times, self.times[at]), len(n))
        answers = np.bincount(owner, self.answer[at], len(n))
        return short | (bag >= COPIED * size) | (bag >= REPHRASED * size) & (answers >= self.wanted[item])


def document_frequencies(docs: DataFrame, items: Items) -> tuple[np.ndarray, int]:
    """(documents with each term, documents), over all rows."""
    index = items.index

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, rows = np.zeros(len(index), np.int64), 0
        for batch in batches:
            codes, bounds = _coded(batch.column(0), index)
            owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
            ok = codes >= 0
            once = np.unique(owner[ok] * len(index) + codes[ok])
            df += np.bincount(once % max(1, len(index)), minlength=len(index))
            rows += batch.num_rows
        some = np.flatnonzero(df)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1)), pa.array(np.append(df[some], rows))], ["term", "n"])

    counted = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df, total = np.zeros(len(index), np.int64), 0
    for t, n in counted:
        if t < 0:
            total = n
        else:
            df[t] = n
    return df, total


def _products(docs: DataFrame, items: Items, right: np.ndarray) -> np.ndarray:
    """A' A right over the passages of all documents: partial sums from the tasks,
    added by row block; terms x columns of ``right`` floats in all."""
    shared = docs.sparkSession.sparkContext.broadcast((items.index, items.weight, right.astype(np.float32)))
    block = 512

    def part(rows: np.ndarray, cols: np.ndarray, weight: np.ndarray, right_: np.ndarray, out: np.ndarray) -> None:
        """Add the products of some passages' words; ``rows`` ascend."""
        width = len(weight)
        pair, n = np.unique(rows.astype(np.int64) * width + cols, return_counts=True)
        rows, cols = np.divmod(pair, width)
        tf = n.astype(np.float32) * weight[cols]
        first = np.flatnonzero(np.diff(rows, prepend=-1))
        of = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(rows))))
        tf /= np.sqrt(np.add.reduceat(tf * tf, first))[of]
        projected = np.add.reduceat(tf[:, None] * right_[cols], first)
        order = np.argsort(cols, kind="stable")
        begin = np.flatnonzero(np.diff(cols[order], prepend=-1))
        out[cols[order][begin]] += np.add.reduceat(tf[order, None] * projected[of[order]], begin)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight, right_ = shared.value
        out = np.zeros(right_.shape, np.float64)
        for batch in batches:
            codes, bounds = _coded(batch.column(0), index)
            # Passages of each document, numbered through the batch.
            lengths = np.diff(bounds)
            passages = -(-lengths // (STRIDE * CHUNKS))
            first = np.cumsum(passages) - passages
            doc = np.repeat(np.arange(len(lengths)), lengths)
            owner = first[doc] + (np.arange(len(codes)) - bounds[doc]) // (STRIDE * CHUNKS)
            held = np.flatnonzero(codes >= 0)
            for lo in range(0, len(held), 1 << 16):
                # A passage that is cut here counts as two.
                some = held[lo : lo + (1 << 16)]
                part(owner[some], codes[some], weight, right_, out)
        n = len(out)
        release_memory()
        yield pa.RecordBatch.from_arrays([pa.array(list(range(0, n, block)), pa.int64()), pa.array([out[k : k + block].tobytes() for k in range(0, n, block)], pa.binary())], ["row", "part"])

    def add(group: pa.Table) -> pa.Table:
        parts = sum(np.frombuffer(x.as_py()) for x in group.column("part"))
        return pa.table([group.column("row")[:1], pa.array([parts.tobytes()], pa.binary())], names=["row", "part"])

    out = np.zeros(right.shape)
    for row, part_ in docs.select("text").mapInArrow(run, "row long, part binary").groupBy("row").applyInArrow(add, "row long, part binary").collect():
        values = np.frombuffer(bytes(part_)).reshape(-1, right.shape[1])
        out[row : row + len(values)] = values
    return out


def factors(docs: DataFrame, items: Items) -> np.ndarray:
    """Right singular vectors (terms x rank at most) of the items and of the passages
    of all documents, from one pass: with Y = A' A T for orthonormal T, A' A is close
    to Y (T' Y)^-1 Y' (Nystrom)."""
    rank = min(RANK, len(items.index))
    cols = min(len(items.index), rank + OVERSAMPLE)
    test, _ = np.linalg.qr(np.random.default_rng(11).standard_normal((len(items.index), cols)))
    # Items weigh as much as all documents together.
    scale = max(1.0, items.documents / len(items.codes))
    y = _products(docs, items, test) + scale * items.spread(items.times(test))
    small = test.T @ y
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    some = values > 1e-7 * values.max()
    left, _, _ = np.linalg.svd(y @ (vectors[:, some] / np.sqrt(values[some])), full_matrices=False)
    return left[:, :rank].astype(np.float32)


def lcs(a: list[int], masks: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence with an item of ``size`` words,
    given the bit masks of its words' positions (bit-parallel)."""
    full = (1 << size) - 1
    v = full
    for x in a:
        m = masks.get(x)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return size - bin(v).count("1")


def search(docs: DataFrame, items: Items, vectors: np.ndarray, keep: tuple[str, ...]) -> DataFrame:
    """_items (confirmed, ascending), _share (largest common share) and, as _k0,
    _k1 and so on, the columns named in ``keep``, of every row."""
    weighted = vectors * items.weight[:, None]
    of_items = items.times(vectors).astype(np.float32)
    # Squared weight of each term, and last that of words outside the benchmark.
    squares = np.append(items.weight, np.median(items.weight)).astype(np.float64) ** 2
    masks = []
    for codes in items.codes:
        m: dict[int, int] = {}
        for k, c in enumerate(codes.tolist()):
            m[c] = m.get(c, 0) | (1 << k)
        masks.append(m)
    place = np.full(len(items.index), -1, np.int64)
    place[items.dense] = np.arange(len(items.dense))
    # All of this is of the size of one block of items.
    shared = docs.sparkSession.sparkContext.broadcast((items.index, place, weighted[items.dense], weighted, of_items, masks, items.answers, items.ids, items.codes, Runs(items.codes), Sieve(items), squares))
    small_batches(docs.sparkSession, 800)

    def passages(codes: np.ndarray, chunk_of: np.ndarray, last: np.ndarray, place: np.ndarray, dense: np.ndarray, rows_of: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(first passage, sums of the passages' chunks), PART at a time; ``last``
        is the end of the document's chunks, for each chunk."""
        total = len(last)
        known = np.flatnonzero(codes >= 0)
        for lo in range(0, total, PART):
            hi = min(total, lo + PART + CHUNKS - 1)
            a, b = np.searchsorted(chunk_of[known], [lo, hi])
            hits, where = codes[known[a:b]], chunk_of[known[a:b]] - lo
            often = place[hits] >= 0
            counts = np.bincount(where[often] * len(dense) + place[hits[often]], minlength=(hi - lo) * len(dense))
            sums = counts.reshape(hi - lo, len(dense)).astype(np.float32) @ dense
            hits, where = hits[~often], where[~often]
            if len(hits):
                used, begins = np.unique(where, return_index=True)
                sums[used] += np.add.reduceat(rows_of[hits], begins)
            at = np.arange(lo, min(total, lo + PART))
            windows = sums[: len(at)].copy()
            for k in range(1, CHUNKS):
                inside = np.flatnonzero(at + k < last[at])
                windows[inside] += sums[inside + k]
            yield lo, windows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, place, dense, rows_of, targets, item_masks, answers, ids, wanted, runs, sieve, squares = shared.value
        size = max(64, (1 << 21) // len(ids))
        for batch in batches:
            codes, bounds = _coded(batch.column(0), index)
            n = len(bounds) - 1
            lengths = np.diff(bounds)
            chunks = -(-lengths // STRIDE)
            first = np.cumsum(chunks) - chunks
            doc_of = np.repeat(np.arange(n), chunks)
            token_doc = np.repeat(np.arange(n), lengths)
            chunk_of = first[token_doc] + (np.arange(len(codes)) - bounds[token_doc]) // STRIDE
            near: list[np.ndarray] = []
            last = (first + chunks)[doc_of]
            lengths_of = np.concatenate([[0.0], np.cumsum(np.bincount(chunk_of, squares[codes], len(doc_of)))])
            lengths_of = np.sqrt(lengths_of[np.minimum(np.arange(len(last)) + CHUNKS, last)] - lengths_of[:-1])
            for lo, windows in passages(codes, chunk_of, last, place, dense, rows_of):
                norm = COSINE * np.maximum(1e-9, lengths_of[lo : lo + len(windows)]).astype(np.float32)
                for k in range(0, len(windows), size):
                    w, i = np.nonzero(windows[k : k + size] @ targets.T >= norm[k : k + size, None])
                    near.append((lo + k + w) * len(ids) + i)
            d, start, i = runs.find(codes, token_doc, bounds)
            near.append(repeated((first[d] + (start - bounds[d]) // STRIDE) * len(ids) + i, len(ids), sieve.sizes))
            found: dict[int, dict[int, float]] = {}
            window, item = np.divmod(np.unique(np.concatenate(near)), len(ids))
            doc = doc_of[window]
            begin = bounds[doc] + (window - first[doc]) * STRIDE
            end = np.minimum(bounds[doc + 1], begin + np.maximum(STRIDE * CHUNKS, sieve.sizes[item] + STRIDE))
            begin = np.maximum(bounds[doc], begin - STRIDE)
            for k in np.flatnonzero(sieve.passes(codes, begin, end, item)).tolist():
                d, i = int(doc[k]), int(item[k])
                share = confirmed(codes[begin[k] : end[k]], wanted[i], item_masks[i], answers[i])
                if share > found.get(d, {}).get(i, 0.0):
                    found.setdefault(d, {})[i] = share
            out_ids = [sorted({ids[i] for i in found[d]} - {None}) if d in found else [] for d in range(n)]
            share = [max(found[d].values()) if d in found else 0.0 for d in range(n)]
            yield pa.RecordBatch.from_arrays([pa.array(out_ids, pa.list_(pa.int64())), pa.array(share, pa.float64()), *batch.columns[1:]], names)
        release_memory()

    names = ["_items", "_share", *[f"_k{i}" for i in range(len(keep))]]
    inputs = docs.select("text", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    schema = "_items array<long>, _share double" + "".join(f", _k{i} {f.dataType.simpleString()}" for i, f in enumerate(inputs.schema[1:]))
    return inputs.mapInArrow(run, schema)


def repeated(pairs: np.ndarray, items: int, sizes: np.ndarray) -> np.ndarray:
    """Distinct (passage * items + item) of runs, where long items need two runs
    there or in the passages beside it."""
    kinds, n = np.unique(pairs, return_counts=True)
    for side in (kinds - items, kinds + items):
        at = np.minimum(np.searchsorted(kinds, side), max(0, len(kinds) - 1))
        n = n + (kinds[at] == side if len(kinds) else 0)
    return kinds[(n > 1) | (sizes[kinds % items] < MANY_RUNS)]


def confirmed(passage: np.ndarray, item: np.ndarray, masks: dict[int, int], answers: set[int]) -> float:
    """Share of the item's words that the passage has in order, or 0 where that
    does not confirm the item."""
    size = len(item)
    if size < MIN_ITEM:
        at = np.flatnonzero(passage[: len(passage) - size + 1] == item[0]) if len(passage) >= size else ()
        return float(any((passage[k : k + size] == item).all() for k in at))
    words = passage.tolist()
    share = lcs(words, masks, size) / size
    if share >= COPIED or share >= REPHRASED and len(answers.intersection(words)) >= ANSWERS * len(answers):
        return share
    return 0.0


def item_blocks(benchmark: DataFrame) -> Iterator[Items]:
    """The benchmark (the query set) in blocks of ITEM_BLOCK items."""
    rows: list[tuple[int, list[str]]] = []
    for r in benchmark.where("text is not null").orderBy("item_id").toLocalIterator():
        if words := terms_of(r.text):
            rows.append((r.item_id, words))
        if len(rows) == ITEM_BLOCK:
            yield Items(rows)
            rows = []
    if rows:
        yield Items(rows)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids, share of every row."""
    small_batches(docs.sparkSession, 800)
    out = docs.select("doc_id", "text", F.array().cast("array<long>").alias("item_ids"), F.lit(0.0).alias("share"))
    for items in item_blocks(benchmark):
        items.weigh(*document_frequencies(docs, items))
        vectors = factors(docs, items)
        out = search(out, items, vectors, ("doc_id", "text", "item_ids", "share"))
        ids = F.array_sort(F.array_union("_k2", "_items"))
        out = out.select(F.col("_k0").alias("doc_id"), F.col("_k1").alias("text"), ids.alias("item_ids"), F.greatest("_k3", "_share").alias("share"))
    return out.select("doc_id", (F.col("share") > 0).alias("contaminated"), "item_ids", "share")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with all their columns.
    Weights and factors come from all rows for every block of items, so the rows that
    go are those that :func:`decontaminate` marks."""
    small_batches(docs.sparkSession, 800)
    columns, left = docs.columns, docs
    for items in item_blocks(benchmark):
        items.weigh(*document_frequencies(docs, items))
        left = search(left, items, factors(docs, items), tuple(columns)).where(F.col("_share") == 0).select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(columns)])
    return left


def op7_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` against all ``benchmark`` items."""
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
