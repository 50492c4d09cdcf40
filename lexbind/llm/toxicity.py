"""Operator 4: weighted finite-state pattern grammar for toxic clauses.

Five transducers read a clause's words and are composed in this order: insults
and threats become weighted symbols; a negation marks those of the next three
words; reported speech marks those of the rest of the clause; a target makes
those after it targeted, and lets out a threat that waits for it: a threat counts
only beside a target, before or after it in the clause.  The composition is
expanded lazily and remembered.  It scores whole clauses; isolated words have no
score of their own.

Insult terms (words and word stems of any language), threats among them (terms
that mostly stand near a target) and their weights are learned from a bounded
sample of labelled rows, :data:`SAMPLE_ROWS`, that are not held out; how much
each context counts is learned from the same rows by logistic regression.
Closed-class cue words are fixed lists below.

Edge cases: null and empty texts have no clause and get the score of a text
without matches; a null id counts as held out; with no usable labels every
score is the smoothed prior; equal rows score equally, and of repeated labels of
an id the toxic one counts; whole texts are read, in time linear in their length;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import release_memory, small_batches, table

#: Labelled rows that learning looks at (those with the smallest hash of the id).
SAMPLE_ROWS = 8000
#: Shortest stem, fewest toxic rows of a term, largest share of clean rows with
#: it, and least log-likelihood ratio against chance (many stems are tried).
MIN_STEM, MIN_ROWS, MAX_CLEAN, MIN_RATIO = 4, 4, 0.002, 16.0
MAX_STEM = 12

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER = "insult", "threat", "target", "negation", "report", "other"
#: Closed-class cues (en, de, fr, es).
CUES = {
    TARGET: "you your yours u ur yourself du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti vosotros usted ustedes".split(),
    NEGATION: "not never no nobody isn't aren't wasn't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún".split(),
    REPORT: "said says say wrote called quoted quote claims claimed reported sagte sagt schrieb nannte dit dis écrit appelé dijo dice escribió llamó".split(),
    THREAT: "kill murder stab strangle umbringen töten tuer égorger matar degollar".split(),
}
_CUE = {tag: frozenset(words) for tag, words in CUES.items()}
_CLAUSE = re.compile(r"[.!?;:\n]+")
_WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")


class Symbol(NamedTuple):
    """What the machines pass on for a word: ``kind`` is a tag or OTHER, ``path``
    the context that marked it."""

    kind: str
    weight: float = 0.0
    path: str = "plain"
    word: str = ""


#: Words that a negation reaches.
SCOPE = 3
#: Contexts of a matched term, and their discounts before learning.
PATHS = ("plain", "targeted", "negated", "reported")
DISCOUNT = {"plain": 1.0, "targeted": 1.2, "negated": 0.6, "reported": 0.7}
#: Words between a term and a target that count as near, and the share of a
#: term's places near one from which it is a threat.
NEAR, THREAT_SHARE = 3, 0.6


class Terms:
    """Insults or threats: words with a term as prefix become weighted symbols."""

    start = 0

    def __init__(self, kind: str, terms: dict[str, float]):
        self.kind, self.terms = kind, terms
        self.longest = max(map(len, terms), default=0)

    def step(self, state, x: Symbol):
        if x.kind == OTHER:
            for n in range(min(len(x.word), self.longest), 0, -1):
                if x.word[:n] in self.terms:
                    return state, Symbol(self.kind, self.terms[x.word[:n]])
        return state, x


class Negation:
    """Marks the terms among the SCOPE words after a negation; the state counts them down."""

    start = 0

    def step(self, state, x: Symbol):
        if x.kind == OTHER and x.word in _CUE[NEGATION]:
            return SCOPE, x
        if state and x.weight:
            x = x._replace(path="negated")
        return max(0, state - 1), x


class Report:
    """Marks the terms after a word of reported speech, unless they are negated."""

    start = 0

    def step(self, state, x: Symbol):
        if x.kind == OTHER and x.word in _CUE[REPORT]:
            return 1, x
        if state and x.weight and x.path == "plain":
            x = x._replace(path="reported")
        return state, x


class Target:
    """Makes plain terms after a target targeted; a threat without one waits, and
    goes out at the next target or not at all.  Of waiting threats the heaviest
    stays, so the states are finite."""

    start = (False, None)

    def step(self, state, x: Symbol):
        seen, waiting = state
        if x.kind == OTHER and x.word in _CUE[TARGET]:
            out = waiting._replace(path="targeted") if waiting and waiting.path == "plain" else waiting
            return (True, None), out or x
        if x.kind == THREAT and not seen:
            return (False, max(waiting or x, x, key=lambda t: t.weight)), Symbol(OTHER)
        if seen and x.weight and x.path == "plain":
            x = x._replace(path="targeted")
        return state, x


class Composed:
    """Composition of two transducers, expanded lazily and remembered."""

    def __init__(self, a, b):
        self.a, self.b, self.start = a, b, (a.start, b.start)
        self.known: dict = {}

    def step(self, state, x: Symbol):
        key = (state, x)
        if key not in self.known:
            if len(self.known) > 100_000:
                self.known.clear()
            left, y = self.a.step(state[0], x)
            right, z = self.b.step(state[1], y)
            self.known[key] = (left, right), z
        return self.known[key]


def compose(*machines):
    out = machines[0]
    for m in machines[1:]:
        out = Composed(out, m)
    return out


class Grammar:
    """The composed grammar over learned terms: term -> (kind, weight)."""

    def __init__(self, terms: dict[str, tuple[str, float]]):
        import ahocorasick

        insults = {t: w for t, (kind, w) in terms.items() if kind == INSULT}
        threats = {t: 2.0 for t in CUES[THREAT]} | {t: w for t, (kind, w) in terms.items() if kind == THREAT}
        self.machine = compose(Terms(INSULT, insults), Terms(THREAT, threats), Negation(), Report(), Target())
        self.finder = ahocorasick.Automaton()
        for term in [*insults, *threats]:
            self.finder.add_word(term, len(term))
        self.finder.make_automaton()

    def clause(self, words: list[str]) -> list[Symbol]:
        """Terms that a clause's words give."""
        state, out = self.machine.start, []
        for word in words:
            state, x = self.machine.step(state, Symbol(OTHER, word=word))
            if x.weight:
                out.append(x)
        return out

    def evidence(self, text: str) -> np.ndarray:
        """Summed weights of the clauses' terms by path, and the largest clause weight."""
        text = text.lower()
        sums, top, marks, done = dict.fromkeys(PATHS, 0.0), 0.0, None, -1
        for end, size in self.finder.iter(text):
            at = end - size + 1
            if at < done or (at and text[at - 1].isalpha()):
                continue
            if marks is None:
                marks = [m.start() for m in _CLAUSE.finditer(text)]
            k = bisect(marks, at)
            done = marks[k] if k < len(marks) else len(text)
            total = 0.0
            for x in self.clause(_WORD.findall(text[marks[k - 1] if k else 0 : done])):
                sums[x.path] += x.weight * DISCOUNT[x.path]
                total += x.weight * DISCOUNT[x.path]
            top = max(top, total)
        return np.array([*(math.log1p(sums[p]) for p in PATHS), math.log1p(top), float(top > 0)])


def _ratio(a: int, b: int, base: float) -> float:
    """Log-likelihood ratio of a toxic and b clean rows against the base rate."""
    n = a + b
    return sum(k * math.log(k / (n * r)) for k, r in ((a, base), (b, 1 - base)) if k)


def learn_terms(rows: list[tuple[str, int]]) -> dict[str, tuple[str, float]]:
    """Stem -> (insult or threat, log-odds weight) of every stem that toxic rows have
    and clean rows hardly; of a word's prefixes with equal rows only the longest
    stays."""
    words = [set(w for w in _WORD.findall(t.lower()) if len(w) >= MIN_STEM) for t, y in rows if y]
    n1, n0 = len(words), sum(1 for _, y in rows if not y)
    if not n1 or not n0:
        return {}
    stems = [{w[:n] for w in ws for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)} for ws in words]
    toxic = Counter(s for ss in stems for s in ss)
    toxic = {s: n for s, n in toxic.items() if n >= MIN_ROWS}
    clean: Counter = Counter()
    for t, y in rows:
        if not y:
            ws = set(_WORD.findall(t.lower()))
            clean.update({w[:n] for w in ws for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)} & toxic.keys())
    odds = {s: math.log((n + 0.5) / (n1 + 1)) - math.log((clean[s] + 0.5) / (n0 + 1)) for s, n in toxic.items()}
    # A stem must be rare among clean rows, and several times likelier among toxic ones.
    good = {s for s in toxic if clean[s] <= MAX_CLEAN * n0 and odds[s] >= math.log(20) and _ratio(toxic[s], clean[s], n1 / (n1 + n0)) >= MIN_RATIO}
    # A longer stem has a part of the shorter one's rows: with equal counts, the same.
    merged = {s[:n] for s in good for n in range(MIN_STEM, len(s)) if s[:n] in good and (toxic[s[:n]], clean[s[:n]]) == (toxic[s], clean[s])}
    kept = good - merged
    near, places = Counter(), Counter()
    for t, y in rows:
        words = _WORD.findall(t.lower()) if y else []
        aimed = [w in _CUE[TARGET] for w in words]
        for k, w in enumerate(words):
            for s in {w[:n] for n in range(MIN_STEM, min(len(w), MAX_STEM) + 1)} & kept:
                places[s] += 1
                near[s] += any(aimed[max(0, k - NEAR) : k + NEAR + 1])
    return {s: (THREAT if near[s] >= THREAT_SHARE * places[s] else INSULT, odds[s]) for s in sorted(kept)}


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights (last: offset) of a ridge logistic regression, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    prior = np.full(len(w), ridge)
    prior[-1] = 1e-3
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + prior * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(prior)
        step = np.linalg.solve(h, g)
        w -= step * min(1.0, 3 / max(1e-9, float(np.abs(step).max())))
    return w


def train(rows: list[tuple[str, int]]) -> tuple[dict[str, tuple[str, float]], np.ndarray]:
    """(terms, weights) from (text, label) rows.  Terms come from one half and
    the context weights from the other, so that the weights see honest evidence."""
    half = learn_terms(rows[::2])
    grammar = Grammar(half)
    other = rows[1::2] or rows
    x = np.array([grammar.evidence(t) for t, _ in other]).reshape(-1, len(PATHS) + 2)
    y = np.array([v for _, v in other], float)
    if not len(y) or not y.any() or y.all():
        p = (y.sum() + 0.5) / (len(y) + 2)
        return learn_terms(rows), np.array([0.0] * (len(PATHS) + 2) + [math.log(p / (1 - p))])
    return learn_terms(rows), logistic(x, y, 0.05)


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[dict[str, tuple[str, float]], np.ndarray]:
    """Learn from at most ``rows`` labelled documents whose crc32(doc_id) mod 5 is not 0."""
    marked = labels.where("toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("_toxic"))
    marked = marked.withColumn("_at", F.xxhash64("doc_id", F.lit("toxic"))).orderBy("_at", "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(marked), "doc_id").orderBy("_at", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))).limit(rows)
    return train([(r.text or "", int(r._toxic)) for r in sample.toLocalIterator()])


def score(docs: DataFrame, model: tuple[dict[str, tuple[str, float]], np.ndarray]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    small_batches(docs.sparkSession)
    terms, weights = model  # stems of the sample's toxic rows, each of MIN_ROWS rows at least

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(terms)
        for batch in batches:
            x = np.array([grammar.evidence(t or "") for t in batch.column(2).to_pylist()]).reshape(-1, len(weights) - 1)
            p = 1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
        release_memory()

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(rows, f"doc_id {kind}, held_out boolean, score double, predicted int")


def op4_toxicity_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole ``documents`` text."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
