"""Operator 3: hashed n-gram logistic regression over labelled quality rows.

Features of a text: hashed word unigrams and bigrams (lower-cased by ASCII),
hashed character trigrams, and a few shape ratios, each group scaled to unit
length.  A logistic regression is trained by stochastic gradient steps on a
bounded sample of labelled rows (:data:`SAMPLE_ROWS`, documented limit), then
calibrated by Platt scaling on the sample's held-out fold.  Texts are scored in
Arrow batches against fixed thresholds on the calibrated probability.

Everything else covers all rows and whole texts.

Edge cases: a null text counts as empty; an empty text has no words and fails
the base rule; rows with null labels are not used for training; with no usable
labels every text keeps the base verdict; equal rows score equally.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import kept_name, release_memory, small_batches, table

#: Labelled rows that training looks at (those with the smallest hash of the
#: id); a text of the sample counts whole.
SAMPLE_ROWS = 3000
#: Hash buckets of word and of character n-grams.
WORD_BUCKETS = 1 << 16
CHAR_BUCKETS = 1 << 15
SHAPES = 8
SIZE = WORD_BUCKETS + CHAR_BUCKETS + SHAPES
EPOCHS, RATE, DECAY = 12, 1.0, 1e-6
#: A text is kept if its calibrated probability of good quality reaches this.
KEEP_AT = 0.4
#: Base rule: fewest words, and largest share (percent) of repeated words.
MIN_WORDS, MAX_REPEAT = 50, 50

_SYMBOLS = re.compile(r"[#*$%&|<>]")
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def base_figures(text: str) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated
    3-word windows) of a text."""
    words = _words(text)
    n = len(words)
    seen: set[str] = set()
    dup_lines = 0
    for line in text.split("\n"):
        if line and not line.isascii() or line.strip(" \t\r\x0b\x0c"):
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    return n, sum(map(len, words)), len(_SYMBOLS.findall(text)), dup_lines, _repeats(words)


_SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def _words(text: str) -> list[str]:
    # str.split() also splits at non-ASCII spaces and \x1c-\x1f, so only plain texts take it.
    if text.isascii() and not _ODD.search(text):
        return text.split()
    return _SPLIT.findall(text)


_ODD = re.compile(r"[\x1c-\x1f]")


def _repeats(words: list[str]) -> int:
    """Words that lie in a 3-word window found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    index: dict[str, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    v = len(index)
    if v < 2_000_000:
        keys = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:
        _, pair = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)
        keys = pair[:-1] * v + ids[2:]
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def _hashed(data: bytes) -> int:
    import zlib

    return zlib.crc32(data)


def features(text: str, figures: tuple[int, int, int, int, int], cache: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """(indices, weights) of a text's features; ``cache`` remembers word hashes."""
    raw = text.encode("utf-8", "surrogatepass").lower()
    words = raw.split()
    if not words:
        return np.array([SIZE - 1]), np.ones(1, np.float32)
    get = cache.get
    hashes = []
    for w in words:
        h = get(w)
        if h is None:
            h = cache[w] = _hashed(w)
        hashes.append(h)
    h = np.array(hashes, np.uint64)
    pair = (h[:-1] * _M1 ^ h[1:]) * _M2
    word = np.bincount(np.concatenate([(h * _M1) >> np.uint64(48), pair >> np.uint64(48)]).astype(np.int64), minlength=WORD_BUCKETS)
    b = np.frombuffer(raw, np.uint8).astype(np.uint64)
    chars = np.bincount((((b[:-2] << np.uint64(16) | b[1:-1] << np.uint64(8) | b[2:]) * _M1) >> np.uint64(49)).astype(np.int64), minlength=CHAR_BUCKETS) if len(b) > 2 else np.zeros(CHAR_BUCKETS, np.int64)
    n, word_chars, symbols, dup_lines, repeats = figures
    upper = len(_UPPER.findall(text))
    shapes = np.array([symbols / max(1, word_chars), repeats / n if n else 0, upper / max(1, word_chars), min(1.0, dup_lines / 5), len(set(words)) / len(words), min(1.0, n / 500), min(1.0, word_chars / max(1, n) / 20), 1.0], np.float32)
    out_i, out_w = [], []
    for at, counts in ((0, word), (WORD_BUCKETS, chars)):
        (k,) = counts.nonzero()
        w = np.sqrt(counts[k]).astype(np.float32)
        out_i.append(k + at)
        out_w.append(w / max(1e-6, float(np.sqrt((w * w).sum()))))
    return np.concatenate([*out_i, np.arange(SIZE - SHAPES, SIZE)]), np.concatenate([*out_w, shapes])


_UPPER = re.compile(r"[A-Z]")


def train(rows: list[tuple[str, int, int]]) -> tuple[np.ndarray, float, float]:
    """(weights, slope, offset) from (text, label, fold) rows: probability =
    sigmoid(slope * score + offset).  Fold 0 calibrates and is not trained on."""
    cache: dict[bytes, int] = {}
    made = [(features(t, base_figures(t), cache), y, fold) for t, y, fold in rows]
    fit = [(x, y) for x, y, fold in made if fold]
    held = [(x, y) for x, y, fold in made if not fold]
    w = np.zeros(SIZE, np.float64)
    if not fit or len({y for _, y in fit}) < 2:
        return w, 0.0, 40.0
    good = sum(y for _, y in fit)
    weight = (len(fit) / (2 * (len(fit) - good)), len(fit) / (2 * good))
    grads = np.full(SIZE, 1e-2)
    order = np.random.default_rng(7)
    for epoch in range(EPOCHS):
        for k in order.permutation(len(fit)):
            (i, v), y = fit[k]
            p = 1 / (1 + np.exp(-float(w[i] @ v)))
            g = (p - y) * weight[y] * v + DECAY * w[i]
            grads[i] += g * g
            w[i] -= RATE * g / np.sqrt(grads[i])
    scored = [(float(w[i] @ v), y) for (i, v), y in (held or fit)]
    return w, *platt(np.array([s for s, _ in scored]), np.array([y for _, y in scored]))


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the calibrating sigmoid, by Newton steps on smoothed targets."""
    pos = labels.sum()
    t = np.where(labels == 1, (pos + 1) / (pos + 2), 1 / (len(labels) - pos + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * scores + b, -40, 40)))
        g = np.array([((p - t) * scores).sum() + 1e-3 * (a - 1), (p - t).sum()])
        d = p * (1 - p)
        h = np.array([[(d * scores * scores).sum() + 1e-3, (d * scores).sum()], [(d * scores).sum(), d.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        if not np.isfinite(step).all():
            break
        scale = min(1.0, 2 / max(1e-9, float(np.abs(step).max())))
        a, b = a - scale * step[0], b - scale * step[1]
    return float(a), float(b)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float, float]:
    """Train on at most ``rows`` labelled documents, the same ones at every run:
    those with the smallest hash of the id."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    marked = marked.withColumn("_at", F.xxhash64("doc_id", F.lit("quality"))).orderBy("_at", "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").orderBy("_at", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).limit(rows)
    return train([(r.text or "", int(r._quality), r._at % 5) for r in sample.collect()])


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base figures, base_failed, quality (calibrated probability), kept,
    and the columns named in ``keep``, unchanged; those with the name of a figure
    as ``input_`` and the name."""
    small_batches(docs.sparkSession)
    weights, slope, offset = model
    shared = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), slope, offset))  # SIZE floats, fixed
    inputs = docs.select("doc_id", "text", *[F.col(c).alias(f"_k{i}") for i, c in enumerate(keep)])
    kinds = [f.dataType.simpleString() for f in inputs.schema[2:]]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, a, b = shared.value
        cache: dict[bytes, int] = {}
        for batch in batches:
            if len(cache) > 100_000:
                cache.clear()
            out = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                figures = base_figures(text)
                n, repeats = figures[0], figures[4]
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT * n
                i, v = features(text, figures, cache)
                p = 1 / (1 + np.exp(-np.clip(a * float(w[i] @ v) + b, -40, 40)))
                out.append((*figures, failed, float(p), not failed and bool(p >= KEEP_AT)))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], names)
        del cache
        release_memory()

    fixed = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    names = ["doc_id", *fixed, "base_failed", "quality", "kept", *[f"_k{i}" for i in range(len(keep))]]
    schema = f"doc_id {inputs.schema[0].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in fixed) + ", base_failed boolean, quality double, kept boolean"
    schema += "".join(f", _k{i} {kind}" for i, kind in enumerate(kinds))
    out = inputs.mapInArrow(rows, schema)
    return out.withColumnsRenamed({f"_k{i}": kept_name(c, names) for i, c in enumerate(keep)}) if keep else out


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float, float]) -> DataFrame:
    """The rows that the rules keep, with all their columns."""
    columns = docs.columns
    renamed = docs.select("doc_id", "text", *[F.col(c).alias(f"_in{i}") for i, c in enumerate(columns)])
    scored = score(renamed, model, tuple(f"_in{i}" for i in range(len(columns)))).where("kept")
    return scored.select(*[F.col(f"_in{i}").alias(c) for i, c in enumerate(columns)])


def op3_quality_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures and verdict for every whole ``documents`` text."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
