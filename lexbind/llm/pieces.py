"""Operator 10: SentencePiece encoding and decoding by suffix-array matching.

The batch's distinct segments (text cut before every run of spaces, which no
piece crosses) are concatenated and indexed by a suffix array.  Every piece of
the vocabulary is binary-searched in it, which gives its occurrence ranges; the
occurrences become edges (position, length, piece), sorted by position.  For
unigram models the edges are relaxed left to right for the best path.  For BPE
models (scores are merge ranks) relaxation follows the merge rule: an edge is
taken when its two halves are current symbols and no adjacent edge ranks
higher, leftmost first; this reproduces the library's ids.  Characters that no
piece covers become byte pieces.

The suffix array sorts suffixes by their first LONGEST bytes: no piece is
longer, so the truncated order answers the same searches.

Edge cases: null text encodes to no ids and decodes to the empty text; empty
likewise; very long segments (no spaces) take a heap in place of rounds; a
literal U+2581 in a text decodes as a space, as in the library; equal rows give
equal rows; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import kept_name, release_memory, small_batches, table

SPACE = "▁"
CACHE_SEGMENTS = 200_000
#: Segments of at most so many characters advance together in rounds.
ROUND_CHARS = 64
#: Characters of segments that one suffix array indexes.
INDEX_CHARS = 400_000


class Vocabulary:
    """Pieces, scores and kinds of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.vocab_size()
        self.piece = [sp.id_to_piece(i) for i in range(self.size)]
        self.score = np.array([sp.get_score(i) for i in range(self.size)])
        self.unknown = sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, np.int64)
        normal = []
        for i, p in enumerate(self.piece):
            if sp.is_byte(i):
                self.byte_ids[int(p[3:5], 16)] = i
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal.append(i)
        self.has_bytes = bool((self.byte_ids != self.unknown).any())
        self.id_of = {self.piece[i]: i for i in normal}
        self.longest = max(len(self.piece[i]) for i in normal)
        #: Searchable pieces (more than one character): ids, lengths, and code points padded with -1.
        many = [i for i in normal if len(self.piece[i]) > 1]
        self.many = np.array(many, np.int64)
        self.widths = np.array([len(self.piece[i]) for i in many], np.int64)
        self.points = np.full((len(many), self.longest), -1, np.int64)
        for row, i in enumerate(many):
            self.points[row, : len(self.piece[i])] = list(map(ord, self.piece[i]))
        self.single = {ord(self.piece[i]): i for i in normal if len(self.piece[i]) == 1}
        self.bpe = _is_bpe(path)
        #: Bytes of each piece when decoded.
        self.raw = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else " ⁇ ".encode() if sp.is_unknown(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(self.piece)]


def _is_bpe(path: str) -> bool:
    """Whether a model file's trainer type is BPE (field 3 of message 2)."""
    with open(path, "rb") as f:
        data = f.read()

    def varint(at):
        value = shift = 0
        while True:
            b = data[at]
            value |= (b & 127) << shift
            at, shift = at + 1, shift + 7
            if b < 128:
                return value, at

    def fields(at, end):
        while at < end:
            key, at = varint(at)
            if key & 7 == 0:
                value, at = varint(at)
            elif key & 7 == 2:
                size, at = varint(at)
                value, at = (at, at + size), at + size
            else:
                value, at = None, at + (8 if key & 7 == 1 else 4)
            yield key >> 3, value

    for number, value in fields(0, len(data)):
        if number == 2:
            return any(n == 3 and v == 2 for n, v in fields(*value))
    return False


def suffix_array(codes: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix positions in order, packed keys in order).  Suffixes compare by
    their first ``longest`` symbols; symbols are dense ranks, packed several to
    a 64-bit key word, and later words sort only where earlier ones tie."""
    n = len(codes)
    bits = max(1, int(codes.max()).bit_length()) if n else 1
    per = 63 // bits
    words = -(-longest // per)
    padded = np.concatenate([codes, np.zeros(words * per, np.int64)])
    keys = np.zeros((words, n), np.int64)
    for w in range(words):
        for k in range(per):
            at = w * per + k
            keys[w] = (keys[w] << bits) | (padded[at : at + n] if at < longest else 0)
    return np.lexsort(keys[::-1]), keys


def occurrences(codes: np.ndarray, pieces: np.ndarray, size: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, piece row) of every occurrence of every piece, sorted by
    position.  ``codes`` are dense ranks from 1 (0 ends a segment); ``pieces``
    has a row of such ranks for each piece, of which the first ``size`` count."""
    order, keys = suffix_array(codes, longest)
    bits = max(1, int(codes.max()).bit_length()) if len(codes) else 1
    per = 63 // bits
    lo_bound, hi_bound = np.zeros(len(pieces), np.int64), np.full(len(pieces), len(order), np.int64)
    for w in range(len(keys)):
        live = np.flatnonzero((size > w * per) & (lo_bound < hi_bound))
        low, high = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
        for k in range(per):
            at = w * per + k
            inside = size[live] > at
            symbol = pieces[live, at] if at < pieces.shape[1] else np.zeros(len(live), np.int64)
            low = (low << bits) | np.where(inside, symbol, 0)
            high = (high << bits) | np.where(inside, symbol, (1 << bits) - 1)
        column = keys[w][order]
        if w == 0:
            lo_bound[live] = np.searchsorted(column, low, "left")
            hi_bound[live] = np.searchsorted(column, high, "right")
        else:  # inside the range that the earlier words left
            for i, a, b in zip(live.tolist(), low.tolist(), high.tolist()):
                begin = lo_bound[i]
                part = column[begin : hi_bound[i]]
                lo_bound[i], hi_bound[i] = begin + np.searchsorted(part, a, "left"), begin + np.searchsorted(part, b, "right")
    counts = np.maximum(0, hi_bound - lo_bound)
    which = np.repeat(np.arange(len(pieces)), counts)
    rank = np.repeat(lo_bound, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    position = order[rank]
    sort = np.argsort(position, kind="stable")
    return position[sort], which[sort]


class Encoder:
    """Encodes batches of segments against a vocabulary."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def segments(self, text: str) -> list[str]:
        """Cuts before each run of spaces, after the leading dummy space."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        parts = marked.split(SPACE)
        out, run = [], 0
        for k, part in enumerate(parts):
            if k:
                run += 1
            if part:
                out.append(SPACE * run + part)
                run = 0
        if run:
            out.append(SPACE * run)
        return out

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment as 32-bit integers."""
        out: list[bytes] = [b""] * len(segments)
        short = [k for k, s in enumerate(segments) if len(s) <= ROUND_CHARS]
        for k, s in enumerate(segments):
            if len(s) > ROUND_CHARS:
                out[k] = array("I", self._long(s)).tobytes()
        lo = 0
        while lo < len(short):
            hi, size = lo, 0
            while hi < len(short) and size < INDEX_CHARS:
                size += len(segments[short[hi]]) + 1
                hi += 1
            for k, ids in zip(short[lo:hi], self._indexed([segments[k] for k in short[lo:hi]])):
                out[k] = ids
            lo = hi
        return out

    def _indexed(self, segments: list[str]) -> list[bytes]:
        """Segments through the suffix array, all together."""
        v = self.vocabulary
        points = np.frombuffer("\0".join([*segments, ""]).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        sizes = np.array([len(s) for s in segments], np.int64)
        stops = np.cumsum(sizes + 1) - 1
        inside = np.ones(len(points), bool)
        inside[stops] = False
        alphabet = np.unique(points[inside])
        codes = np.where(inside, np.searchsorted(alphabet, points) + 1, 0)
        at = np.minimum(np.searchsorted(alphabet, v.points), max(0, len(alphabet) - 1))
        ranks = np.where((v.points >= 0) & (alphabet[at] == v.points), at + 1, 0) if len(alphabet) else np.zeros_like(v.points)
        usable = np.flatnonzero((ranks > 0).sum(axis=1) == v.widths)
        position, which = occurrences(codes, ranks[usable], v.widths[usable], v.longest)
        ids, width = v.many[usable][which], v.widths[usable][which]
        stride = v.longest + 1
        edge = position * stride + width
        sort = np.argsort(edge, kind="stable")
        edge, ids = edge[sort], ids[sort]
        if v.bpe:
            begins, pick = self._merge(points, inside, stops, edge, ids, stride)
        else:
            begins, pick = self._best_path(points, inside, edge, ids, stride)
        return self._emit(points, begins, pick, stops)

    def _merge(self, points, inside, stops, edge, ids, stride):
        """Rounds over all segments at once: in each, every segment takes its
        best-ranked adjacent edge (leftmost on ties)."""
        v = self.vocabulary
        n = len(points)
        nxt = np.arange(1, n + 1)
        owner = np.cumsum(~inside) - ~inside  # segment of each position
        live = np.flatnonzero(inside)
        alphabet, back = np.unique(points, return_inverse=True)
        pick = np.array([v.single.get(int(c), -1) for c in alphabet], np.int64)[back]
        scores = v.score

        def joined(at):
            """Piece of the edge that joins a symbol to its right neighbour, or -1."""
            mid = nxt[at]
            end = np.where(mid < n, nxt[np.minimum(mid, n - 1)], mid)
            span = end - at
            ok = inside[np.minimum(mid, n - 1)] & (span < stride)
            key = at * stride + np.where(ok, span, 0)
            k = np.minimum(np.searchsorted(edge, key), max(0, len(edge) - 1))
            hit = ok & (edge[k] == key) if len(edge) else np.zeros(len(at), bool)
            return np.where(hit, ids[k] if len(edge) else -1, -1)

        right = np.full(n, -1, np.int64)
        right[live] = joined(live)
        while len(live):
            piece = right[live]
            can = piece >= 0
            if not can.any():
                break
            seg = owner[live]
            firsts = np.flatnonzero(np.concatenate([[True], seg[1:] != seg[:-1]]))
            value = np.where(can, scores[piece], -np.inf)
            top = np.maximum.reduceat(value, firsts)
            group = np.cumsum(np.concatenate([[0], (seg[1:] != seg[:-1]).astype(np.int64)]))
            is_top = can & (value == top[group])
            where = np.flatnonzero(is_top)
            lead = where[np.concatenate([[True], group[where][1:] != group[where][:-1]])]
            at = live[lead]
            gone = nxt[at]
            pick[at] = right[at]
            nxt[at] = nxt[gone]
            right[gone] = -1
            drop = np.zeros(n, bool)
            drop[gone] = True
            alive = np.isfinite(top)[group] & ~drop[live]
            before = np.full(len(lead), -1, np.int64)
            has = lead > 0
            has[has] = group[lead[has] - 1] == group[lead[has]]
            before[has] = live[lead[has] - 1]
            live = live[alive]
            right[at] = joined(at)
            before = before[before >= 0]
            right[before] = joined(before)
        # Symbols left: starts that no merge swallowed.
        span = nxt - np.arange(n)
        heads = np.flatnonzero(span > 1)
        mark = np.zeros(n + 1, np.int64)
        np.add.at(mark, heads + 1, 1)
        np.add.at(mark, nxt[heads], -1)
        swallowed = np.cumsum(mark)[:n] > 0
        return inside & ~swallowed, pick

    def _best_path(self, points, inside, edge, ids, stride):
        """Left-to-right relaxation of the sorted edges (unigram models)."""
        v = self.vocabulary
        n = len(points)
        floor = float(v.score.min()) - 10
        best = np.full(n + 1, -np.inf)
        from_, with_ = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
        begin, width = edge // stride, edge % stride
        firsts = np.searchsorted(begin, np.arange(n + 1))
        best[0] = 0
        for at in range(n):
            if not inside[at]:
                best[at + 1], from_[at + 1] = 0.0, at
                continue
            one = v.single.get(int(points[at]), -1)
            options = [(1, one, v.score[one] if one >= 0 else floor)]
            options += [(int(width[k]), int(ids[k]), v.score[ids[k]]) for k in range(firsts[at], firsts[at + 1])]
            for w, piece, s in options:
                if best[at] + s > best[at + w]:
                    best[at + w], from_[at + w], with_[at + w] = best[at] + s, at, piece
        begins, pick = np.zeros(n, bool), np.full(n, -1, np.int64)
        at = n
        while at > 0:
            back = from_[at]
            if inside[back]:
                begins[back], pick[back] = True, with_[at]
            at = back
        return begins, pick

    def _emit(self, points, begins, pick, stops) -> list[bytes]:
        """Ids of each segment; uncovered characters as byte pieces."""
        v = self.vocabulary
        at = np.flatnonzero(begins)
        piece = pick[at]
        out = piece.copy()
        bad = np.flatnonzero(piece < 0)
        bounds = np.searchsorted(at, np.concatenate([[0], stops]))
        if not len(bad):
            raw = out.astype("<u4").tobytes()
            return [raw[4 * a : 4 * b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        result, values = [], out.tolist()
        bad_at = {int(k): self._bytes(int(points[at[k]])) for k in bad}
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            ids: list[int] = []
            for k in range(a, b):
                if values[k] < 0:
                    ids += bad_at[k]
                else:
                    ids.append(values[k])
            result.append(array("I", ids).tobytes())
        return result

    def _bytes(self, point: int) -> list[int]:
        v = self.vocabulary
        if not v.has_bytes:
            return [v.unknown]
        return [int(v.byte_ids[b]) for b in chr(point).encode("utf-8", "surrogatepass")]

    def _long(self, segment: str) -> list[int]:
        """One long segment: merges by a heap (BPE) or the path over its own index."""
        v = self.vocabulary
        if not v.bpe:
            return np.frombuffer(self._indexed([segment])[0], "<u4").tolist()
        n = len(segment)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        pick = [v.single.get(ord(c), -1) for c in segment]
        heap: list = []

        def push(a):
            b = nxt[a]
            if b < n:
                end = nxt[b]
                if end - a <= v.longest:
                    piece = v.id_of.get(segment[a:end])
                    if piece is not None:
                        heapq.heappush(heap, (-v.score[piece], a, b, end, piece))

        for a in range(n):
            push(a)
        while heap:
            _, a, b, end, piece = heapq.heappop(heap)
            if not (alive[a] and b < n and alive[b] and nxt[a] == b and nxt[b] == end):
                continue
            alive[b] = False
            nxt[a] = end
            pick[a] = piece
            if end < n:
                prev[end] = a
            push(a)
            if prev[a] >= 0:
                push(prev[a])
        out: list[int] = []
        for a in range(n):
            if alive[a]:
                out += self._bytes(ord(segment[a])) if pick[a] < 0 else [pick[a]]
        return out

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text."""
        if len(self.cache) > CACHE_SEGMENTS:
            self.cache, self.older = {}, self.cache
        split = [self.segments(t or "") for t in texts]
        cache, older = self.cache, self.older
        new = []
        for s in set().union(*split).difference(cache):
            known = older.get(s)
            if known is None:
                new.append(s)
            else:
                cache[s] = known
        cache.update(zip(new, self.encode_segments(new)))
        get = cache.__getitem__
        return [np.frombuffer(b"".join(map(get, parts)), "<u4") for parts in split]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, without the dummy space."""
        raw = self.vocabulary.raw
        out = b"".join([raw[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return out[1:] if out.startswith(" ") else out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a model file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_decode(docs: DataFrame, path: str, keep: tuple[str, ...] = (), with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_crc32 (UTF-8), round_trip, the ids
    if asked for, and the columns named in ``keep`` (``input_`` before the name of
    one that clashes)."""
    small_batches(docs.sparkSession, 700)
    inputs = docs.select("doc_id", "text", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out: list[list] = [[], [], [], []]
            coded = coder.encode(texts)
            for text, ids in zip(texts, coded):
                back = coder.decode(ids)
                out[0].append(len(ids))
                out[1].append(zlib.crc32(ids.tobytes()))
                out[2].append(zlib.crc32(back.encode("utf-8", "surrogatepass")))
                out[3].append(back == (text or "").replace(SPACE, " "))
            columns = [batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.bool_())]
            if with_ids:
                columns.append(pa.array([i.astype(np.int32) for i in coded], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays([*columns, *batch.columns[2:]], names)
        release_memory()

    names = ["doc_id", "n_pieces", "ids_crc32", "decoded_crc32", "round_trip", *(["piece_ids"] if with_ids else []), *[f"_k{i}" for i in range(len(keep))]]
    schema = f"doc_id {inputs.schema[0].dataType.simpleString()}, n_pieces long, ids_crc32 long, decoded_crc32 long, round_trip boolean" + (", piece_ids array<int>" if with_ids else "")
    schema += "".join(f", _k{i} {f.dataType.simpleString()}" for i, f in enumerate(inputs.schema[2:]))
    return inputs.mapInArrow(rows, schema).withColumnsRenamed({f"_k{i}": kept_name(c, names) for i, c in enumerate(keep)})


def op10_suffix_array_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all whole ``documents``."""
    import public_tokenizers

    return encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
