"""Operator 1: token ids in Simple-8b files.

File format (all integers little-endian), one file image per task and about
``FILE_IDS`` ids::

    magic    8 bytes  b"S8BIDS01"
    counts   u64 x 4  documents, ids, blocks, 64-bit code words
    base     u64      ids of this task's earlier files
    docs     for each document: i64 id (2**63-1 for a null id), u64 ids
    blocks   for each block of BLOCK_IDS ids: u64 first code word
    words    the code words

A code word's top four bits select how many ids it packs and at what width
(``WIDTHS``); selector 15 is an escape: its low bits are zero and the next
code word is one id of up to 64 bits, verbatim.  Code words never span blocks,
so blocks decode independently, and each selector's words decode as one vector
operation.

File images travel as a binary column of a Spark table in the shared folder,
so the commit protocol covers task retries and lost executors;
:func:`export_files` writes them as plain files.

Edge cases: a null text is empty and yields the end id alone; null ids sort
first and are kept; equal ids keep all their rows, ordered by the text's crc32;
texts of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import small_batches, stored, table

MAGIC = b"S8BIDS01"
#: (ids in a code word, bits of each) by selector; selector 15 escapes.
WIDTHS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 15
BLOCK_IDS = 1024
FILE_IDS = 1_000_000
#: The word tokenizer's own pre-tokenizer pattern, and what of it stands between
#: runs of letters.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BETWEEN = r"('s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+)"
#: What makes a text not plain: controls, anything above Latin Extended-B (below
#: it, lower-casing and composing act on single characters), a special token.
ODD = r"[^\t-\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}]|<\|"
#: Words of a cache generation; a worker remembers two generations, so words
#: that keep coming stay.
CACHE_WORDS = 350_000
NULL_ID = 2**63 - 1


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs (at least 1), exact for 64-bit values."""
    if not len(ids) or ids.max() < 1 << 52:  # a double's exponent tells
        return np.maximum(np.frexp(ids.astype(np.float64))[1], 1).astype(np.uint8)
    out = np.ones(len(ids), np.uint8)
    for b in range(1, 64):
        more = ids >= np.uint64(1 << b)
        if not more.any():
            break
        out += more
    return out


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first code word of each block, code words) of an id array.

    Which selector fits at a position comes from sliding maxima over the bit
    widths; all blocks then advance together, one code word a round.
    """
    ids = np.ascontiguousarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK_IDS)
    bits = np.full(blocks * BLOCK_IDS + 64, 1, np.uint8)
    bits[:n] = _bits(ids)
    window, span = bits.copy(), 1
    best = np.full(len(bits), len(WIDTHS), np.uint8)  # len(WIDTHS): escape
    for size, width in reversed(WIDTHS):
        while span < size:
            step = min(span, size - span)
            window = np.maximum(window, np.concatenate([window[step:], np.full(step, 255, np.uint8)]))
            span += step
        best[window <= width] = next(i for i, w in enumerate(WIDTHS) if w[0] == size)
    at = np.arange(blocks, dtype=np.int64) * BLOCK_IDS
    ends = np.minimum(at + BLOCK_IDS, n)
    counts = np.array([w[0] for w in WIDTHS] + [1], np.int64)
    rows, starts, picks = [], [], []
    live = np.arange(blocks)
    while len(live):
        here = at[live]
        pick = best[here].astype(np.int64)
        # A code word must not reach over the block's end: take narrower counts there.
        over = here + counts[pick] > ends[live]
        while over.any():
            pick[over] += 1
            over &= here + counts[pick] > ends[live]
        rows.append(live)
        starts.append(here)
        picks.append(pick)
        at[live] = here + counts[pick]
        live = live[at[live] < ends[live]]
    row, start, pick = np.concatenate(rows), np.concatenate(starts), np.concatenate(picks)
    order = np.lexsort((start, row))
    row, start, pick = row[order], start[order], pick[order]
    slots = 1 + (pick == len(WIDTHS))
    where = np.concatenate([[0], np.cumsum(slots)])
    words = np.zeros(where[-1], np.uint64)
    for selector, (size, width) in enumerate(WIDTHS):
        mine = np.flatnonzero(pick == selector)
        if len(mine):
            packed = np.full(len(mine), selector << 60, np.uint64)
            for k in range(size):
                packed |= ids[start[mine] + k] << np.uint64(k * width)
            words[where[mine]] = packed
    mine = np.flatnonzero(pick == len(WIDTHS))
    words[where[mine]] = np.uint64(ESCAPE << 60)
    words[where[mine] + 1] = ids[start[mine]]
    return where[np.searchsorted(row, np.arange(blocks))].astype(np.uint64), words


def decode_words(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of code words, by one vector operation for each selector."""
    if not n:
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    literal = np.zeros(len(words), bool)
    for at in np.flatnonzero(selector == ESCAPE):  # left to right: a literal may look like an escape
        if not literal[at]:
            literal[at + 1] = True
    counts = np.array([w[0] for w in WIDTHS] + [0, 0], np.int64)[selector]
    counts[literal] = 1
    offsets = np.concatenate([[0], np.cumsum(counts)])[:-1]
    out = np.zeros(n, np.uint64)
    out[offsets[literal]] = words[literal]
    for s, (size, width) in enumerate(WIDTHS):
        mine = np.flatnonzero((selector == s) & ~literal)
        for k in range(size if len(mine) else 0):
            out[offsets[mine] + k] = (words[mine] >> np.uint64(k * width)) & np.uint64((1 << width) - 1)
    return out


def pack_file(doc_ids: list[int], lengths: list[int], ids: np.ndarray, base: int) -> bytes:
    """A file image."""
    firsts, words = encode_words(ids)
    head = np.array([len(doc_ids), len(ids), len(firsts), len(words), base], "<u8")
    docs = np.empty((len(doc_ids), 2), "<i8")
    docs[:, 0], docs[:, 1] = doc_ids, lengths
    return MAGIC + head.tobytes() + docs.tobytes() + firsts.astype("<u8").tobytes() + words.astype("<u8").tobytes()


def unpack_file(image: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(document ids, ids of each document, all ids, base) of a file image."""
    if image[:8] != MAGIC:
        raise ValueError("not a Simple-8b id file")
    n_docs, n_ids, n_blocks, n_words, base = np.frombuffer(image, "<u8", 5, 8).astype(int)
    docs = np.frombuffer(image, "<i8", 2 * n_docs, 48).reshape(-1, 2)
    at = 48 + 16 * n_docs
    firsts = np.frombuffer(image, "<u8", n_blocks, at)
    words = np.frombuffer(image, "<u8", n_words, at + 8 * n_blocks)
    return docs[:, 0], docs[:, 1], decode_words(words, firsts, n_ids), int(base)


def decode_block(image: bytes, block: int) -> np.ndarray:
    """The ids of one block, from its offset alone."""
    n_docs, n_ids, n_blocks, n_words, _ = np.frombuffer(image, "<u8", 5, 8).astype(int)
    at = 48 + 16 * n_docs
    firsts = np.append(np.frombuffer(image, "<u8", n_blocks, at), np.uint64(n_words)).astype(int)
    words = np.frombuffer(image, "<u8", n_words, at + 8 * n_blocks)[firsts[block] : firsts[block + 1]]
    return decode_words(words, np.zeros(1, np.uint64), min(BLOCK_IDS, n_ids - block * BLOCK_IDS))


_TOKENIZERS: dict = {}


def _encoder(path: str) -> list:
    """[tokenizer, cache of piece -> ids as little-endian u32, older generation,
    whether plain texts may be cut into pieces outside the library]."""
    if path not in _TOKENIZERS:
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        lowers = any(x["type"] == "Lowercase" for x in (spec["normalizer"] or {}).get("normalizers", []))
        cuts = lowers and bool(steps) and steps[0].get("pattern") == {"Regex": PIECES}
        _TOKENIZERS[path] = [Tokenizer.from_file(path), {}, {}, cuts]
    return _TOKENIZERS[path]


def _encode_words(words: list[str], tokenizer) -> list[bytes]:
    """Ids of words.  Spaces end a piece, so words that are one piece each go through
    the library as one text, which says whose piece an id is of."""
    e = tokenizer.encode(" ".join(words), add_special_tokens=False)
    piece = np.array(e.word_ids, np.int64) if None not in e.word_ids else np.zeros(0, np.int64)
    cuts = np.flatnonzero(np.diff(piece, prepend=-1))
    if len(cuts) != len(words) or "" in words:
        return [array("I", x.ids).tobytes() for x in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
    raw, at = array("I", e.ids).tobytes(), [*(4 * cuts).tolist(), 4 * len(piece)]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def _encode_plain(texts: pa.Array, state: list) -> tuple[np.ndarray, np.ndarray]:
    """(ids, bounds) of plain texts: pieces of the pre-tokenizer encode
    independently, so each distinct one of a batch is looked up once and unknown
    ones go to the library; ids are then gathered by index."""
    if len(state[1]) > CACHE_WORDS:
        state[1:3] = [{}, state[1]]
    tokenizer, cache, older, _ = state
    cut = pc.replace_substring_regex(pc.utf8_lower(texts), BETWEEN, r" \1 ")
    split = pc.ascii_split_whitespace(cut)
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    found = list(map(cache.get, words))
    new = []
    for at, ids in enumerate(found):
        if ids is None:
            ids = older.get(words[at])
            if ids is None:
                if words[at]:
                    new.append(at)
                else:
                    found[at] = b""
            else:
                found[at] = cache[words[at]] = ids
    for k in range(0, len(new), 1024):
        part = new[k : k + 1024]
        for at, ids in zip(part, _encode_words([words[at] for at in part], tokenizer)):
            found[at] = cache[words[at]] = ids
    known = np.frombuffer(b"".join(found), "<u4")
    size = np.fromiter(map(len, found), np.int64, len(found)) >> 2
    first = np.cumsum(size) - size
    index = coded.indices.to_numpy()
    sizes = size[index]
    at = np.cumsum(sizes)
    ids = known[np.repeat(first[index] - (at - sizes), sizes) + np.arange(at[-1] if len(at) else 0)]
    return ids, np.concatenate([[0], at])[split.offsets.to_numpy()]


def encode_texts(texts: pa.Array, path: str, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, ids of each text) of a string array; nulls are empty.

    Texts that are not plain, and all texts of a tokenizer with other steps, go
    to the library whole.
    """
    state = _encoder(path)
    texts = texts.fill_null("").cast(pa.large_string())
    odd = np.flatnonzero(pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False)) if state[3] else np.arange(len(texts))
    if not len(odd):
        ids, bounds = _encode_plain(texts, state)
    else:
        plain = np.setdiff1d(np.arange(len(texts)), odd)
        ids, bounds = _encode_plain(texts.take(pa.array(plain)), state) if len(plain) else (np.zeros(0, "<u4"), np.zeros(1, np.int64))
        each: list = [None] * len(texts)
        for k, row in enumerate(plain.tolist()):
            each[row] = ids[bounds[k] : bounds[k + 1]]
        for lo in range(0, len(odd), 256):
            part = odd[lo : lo + 256]
            for row, e in zip(part.tolist(), state[0].encode_batch_fast(texts.take(pa.array(part)).to_pylist(), add_special_tokens=False)):
                each[row] = np.array(e.ids, "<u4")
        ids, bounds = np.concatenate(each), np.concatenate([[0], np.cumsum([len(e) for e in each])])
    lengths = np.diff(bounds)
    if end_id is not None:
        ids, lengths = np.insert(ids, bounds[1:], end_id), lengths + 1
    return ids, lengths


def write_ids(docs: DataFrame, path: str, end_id: int | None = 1, name: str = "ids") -> DataFrame:
    """Encode (doc_id, text) and write id files in ascending doc_id order.

    Returns the written table: part, seq (file order inside a part), first_doc
    and the file image.  Parts are doc_id ranges in ascending order; their
    boundaries come from Spark's range partitioner.
    """
    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, base = TaskContext.get().partitionId(), 0, 0
        held: list[np.ndarray] = []
        names: list[int] = []
        sizes: list[int] = []

        def flush():
            nonlocal seq, base
            ids = np.concatenate(held)
            image = pack_file(names, sizes, ids, base)
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([image], pa.binary())], ["part", "seq", "n_ids", "image"])
            seq, base = seq + 1, base + len(ids)
            for x in (held, names, sizes):
                x.clear()
            return row

        for batch in batches:
            ids, lengths = encode_texts(batch.column(1), path, end_id)
            held.append(ids)
            names += [NULL_ID if key is None else key for key in batch.column(0).to_pylist()]
            sizes += lengths.tolist()
            if sum(map(len, held)) >= FILE_IDS:
                yield flush()
        if names:
            yield flush()

    small_batches(docs.sparkSession, 3000)
    ranged = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    ranged = ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")))
    return stored(ranged.mapInArrow(files, "part int, seq int, n_ids long, image binary"), name)


def read_ids(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Documents of written files: doc_id, start, n_tokens, ids_crc32, and the ids if asked for.

    ``start`` needs the ids of earlier parts: one total for each part reaches
    the driver, as many as the write had tasks.
    """
    totals = sorted(files.groupBy("part").agg(F.sum("n_ids")).collect())
    bases, at = {}, 0
    for part, n in totals:
        bases[part] = at
        at += n

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, lengths, ids, base = unpack_file(image.as_py())
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                raw = memoryview(ids).cast("B")
                crcs = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist())]
                columns = [
                    pa.array(doc_ids, pa.int64(), mask=doc_ids == NULL_ID),
                    pa.array(bases[part] + base + ends - lengths, pa.int64()),
                    pa.array(lengths, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], ends]).astype(np.int32), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    return files.select("part", "image").mapInArrow(rows, schema)


def export_files(files: DataFrame, folder: str) -> list[str]:
    """Write the file images to a folder the driver can reach, one at a time."""
    out = []
    for row in files.orderBy("part", "seq").toLocalIterator():
        out.append(f"{folder}/ids-{row.part:05d}-{row.seq:05d}.s8b")
        with open(out[-1], "wb") as f:
            f.write(row.image)
    return out


def op1_simple8b_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all whole ``documents``, write the id files, and read them back."""
    import public_tokenizers

    files = write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_ids(files)
