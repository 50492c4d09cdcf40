"""Operator 6: personal-data spans from boosted trees over candidate spans.

1. Base generators (email, ip, card, phone) and wider generators (secrets, keys,
   loose digit groups) propose spans; all are Java regular expressions inside
   SQL expressions.  Spans found by the base rules stay whatever the trees say.
2. Each wider candidate gets discrete features of two views: its format
   (character classes, length, runs, known prefixes) and its context (quotes and
   cue words beside it).
3. Two models of gradient-boosted trees teach each other: the format model learns
   from labels that the context gives (a cue stands before the span), the context
   model from labels that the format gives (a key prefix, long hex, mixed digits);
   neither sees the features its labels come from.  Features are discrete, so
   training needs only (feature cell, counts) over all rows: at most a few
   thousand cells reach the driver, whatever the input's size.
4. The sum of both scores is calibrated by Platt scaling on all cells, each scored by
   trees that did not see its fold, where either view's label counts.  The trees become one SQL CASE
   expression, and spans of a calibrated probability of KEEP_AT or more are added.

Texts are scanned once: spans and features are stored, and both training and
selection read them.

The main path has no Python on the executors.

Edge cases: a null text has no spans; empty text likewise; long texts are
scanned whole (all repetitions are possessive, so neither time nor stack grows
beyond the text's length); equal rows give equal rows; an empty table trains
nothing and adds nothing; other columns are ignored by the query.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.llm.common import stored, table

#: Base patterns: equal to the contract's, with possessive loops and anchored
#: starts (after the previous match, or where no earlier start could match).
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:\G|(?<![0-9]))(?=[0-9][\x20-]?[0-9])[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Wider generators: key-value secrets, any long token (long words of prose are
#: what the trees learn to leave), and national phone or identity numbers.
TOKEN = r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/-]{16,}+=*+"
ASSIGN = r"(?<![A-Za-z])(?i:password|passwd|pwd|secret|token|api_?key|apikey|access_?key)\s?[=:]\s?[\"']?[^\s\"',;]{4,}+"
GROUPS = r"(?<![0-9A-Za-z+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{2,4}[\x20.-][0-9]{4}(?![0-9])"
#: Kinds in output order.
KINDS = ("email", "ip", "card", "phone", "secret", "key", "number")
BASE = KINDS[:4]
CUES = r"(?i)(?:pass|pwd|secret|token|key|auth|credential|bearer|login)[^\n]{0,12}$"
CALL_CUES = r"(?i)(?:tel|phone|call|fax|mobile|ssn|contact)[^\n]{0,12}$"
#: Tree count, depth-2 trees, shrinkage, and the probability that adds a span.
TREES, SHRINK, KEEP_AT = 24, 0.4, 0.5
#: Folds of rows whose cells are scored by trees of the other folds.
FOLDS = 5
#: Characters of context on the left that features look at.
CONTEXT = 24


def _find(text: Column, pattern: str) -> Column:
    """Array of (start, end) of a pattern's non-overlapping matches, in code
    points: the text between matches and the matches themselves, laid end to end."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern), F.length)
    steps = F.zip_with(gaps, F.transform(found, F.length), lambda g, m: F.struct(F.coalesce(g, F.lit(0)).alias("g"), m.alias("m")))
    steps = F.filter(steps, lambda s: s["m"].isNotNull())
    none = F.array().cast("array<struct<s:int,e:int>>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, s: Column) -> Column:
        begin = acc["at"] + s["g"]
        return F.struct((begin + s["m"]).alias("at"), F.concat(acc["out"], F.array(F.struct(begin.alias("s"), (begin + s["m"]).alias("e")))).alias("out"))

    return F.aggregate(steps, start, step, lambda acc: acc["out"])


def _cut(text: Column, span: Column) -> Column:
    return F.substr(text, span["s"] + 1, span["e"] - span["s"])


def _luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes Luhn's check."""
    reverse = F.transform(F.split(F.reverse(digits), ""), lambda c: c.cast("int"))
    doubled = F.transform(reverse, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, d * 2 - 9).otherwise(d * 2)))
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + F.coalesce(b, F.lit(0))) % 10 == 0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _base_ok(kind: str, text: Column) -> Column:
    """Whether a base match is kept."""
    if kind == "ip":
        parts = F.transform(F.split(text, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= F.lit("255"))))
    if kind == "card":
        digits = _digits(text)
        return F.length(digits).between(16, 19) & F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _keeps(kind: str, text: Column):
    return lambda s: _base_ok(kind, _cut(text, s))


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array of kept base spans of a non-null text.  A cheap test on
    what every match must hold keeps the regular expressions off most texts."""
    out = {}
    needs = {"email": F.instr(text, "@") > 0, "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": F.instr(text, "+") > 0}
    for kind, pattern in zip(BASE, (EMAIL, IP, CARD, PHONE)):
        spans = F.filter(_find(text, pattern), _keeps(kind, text))
        out[kind] = F.when(needs[kind], spans).otherwise(F.array().cast("array<struct<s:int,e:int>>"))
    return out


def _wide_spans(text: Column) -> dict[str, Column]:
    none = F.array().cast("array<struct<s:int,e:int>>")
    cued = text.rlike(r"(?i)passw|pwd|secret|token|key")
    return {
        "secret": F.when(cued, _find(text, ASSIGN)).otherwise(none),
        "key": _find(text, TOKEN),
        "number": F.when(text.rlike(r"[0-9]{3}\)?[\x20.-][0-9]"), _find(text, GROUPS)).otherwise(none),
    }


FEATURES = ("kind", "size", "digits", "cases", "hexes", "prefix", "quoted", "cue", "call", "runs")
#: The features of each view, by place; both have the kind.
FORMAT, CONTEXT_VIEW = (0, 1, 2, 3, 4, 5, 9), (0, 6, 7, 8)


def _features(text: Column, kind: str, span: Column) -> Column:
    """Discrete format and context features of a candidate, each a small int."""
    body = _cut(text, span)
    n = F.greatest(span["e"] - span["s"], F.lit(1))
    digits = F.length(_digits(body))
    before = F.substr(text, F.greatest(span["s"] + 1 - CONTEXT, F.lit(1)), F.least(span["s"], F.lit(CONTEXT)))
    after = F.substr(text, span["e"] + 1, F.lit(1))
    changes = F.length(F.regexp_replace(body, "[0-9]+|[A-Z]+|[a-z]+", "x"))
    return F.struct(
        F.lit(KINDS.index(kind)).alias("kind"),
        F.least(F.floor(n / 4), F.lit(10)).cast("int").alias("size"),
        F.floor(digits * 4 / n).cast("int").alias("digits"),
        (body.rlike("[A-Z]").cast("int") * 2 + body.rlike("[a-z]").cast("int")).alias("cases"),
        body.rlike("^[0-9a-fA-F]+$").cast("int").alias("hexes"),
        F.when(body.rlike("^(?:AKIA|ASIA|ghp_|gho_|sk_|sk-|xox[bp]-|eyJ|AIza)"), 1).otherwise(0).alias("prefix"),
        (before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).cast("int").alias("quoted"),
        before.rlike(CUES).cast("int").alias("cue"),
        before.rlike(CALL_CUES).cast("int").alias("call"),
        F.least(F.floor(changes / 3), F.lit(5)).cast("int").alias("runs"),
    )


def _described(kind: str, text: Column):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["s"].alias("s"), s["e"].alias("e"), _features(text, kind, s).alias("f"))


def candidates(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, base spans by kind, ``wide`` (candidates with features, in text
    order, none overlapping a base span) and the columns named in ``keep``, in a
    struct ``kept``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = base_spans(F.col("_text"))
    kept = [F.struct(*[F.col(c) for c in keep]).alias("kept")] if keep else []
    held = ["kept"] if keep else []
    out = docs.select("doc_id", text.alias("_text"), *kept).select("doc_id", "_text", *held, *[v.alias(k) for k, v in base.items()])
    out = out.withColumns({f"_{k}": v for k, v in _wide_spans(F.col("_text")).items()})
    taken = F.concat(*[F.col(k) for k in BASE])
    wide = []
    for kind in KINDS[4:]:
        free = F.filter(F.col(f"_{kind}"), lambda s: ~F.exists(taken, lambda b: (b["s"] < s["e"]) & (s["s"] < b["e"])))
        wide.append(F.transform(free, _described(kind, F.col("_text"))))
    return out.select("doc_id", *held, *BASE, F.concat(*wide).alias("wide"))


def context_label(f: tuple[int, ...]) -> bool:
    """Whether the words beside a candidate say what it is."""
    return bool(f[7]) if f[0] == KINDS.index("key") else bool(f[8]) if f[0] == KINDS.index("number") else bool(f[6] or f[7])


def format_label(f: tuple[int, ...]) -> bool:
    """Whether a candidate looks like a secret, whatever stands beside it."""
    return bool(f[5]) or (bool(f[4]) and f[1] >= 5) or (f[0] != KINDS.index("number") and 0 < f[2] < 4 and f[9] >= 1) or (f[0] == KINDS.index("number") and f[2] >= 2)


def train(cells: list[tuple[tuple[int, ...], int, int]], view: tuple[int, ...] = tuple(range(len(FEATURES)))) -> list[tuple]:
    """Depth-2 boosted trees on (features, positives, negatives) cells, over the
    features of a view.

    Returns trees (feature, cut, left leaf or (feature, cut, a, b), right ...)
    preceded by the prior log-odds.
    """
    pos, neg = sum(c[1] for c in cells), sum(c[2] for c in cells)
    prior = math.log((pos + 1) / (neg + 1))
    score = [prior] * len(cells)
    trees: list[tuple] = []
    cuts = [(k, v) for k in view for v in sorted({c[0][k] for c in cells})[:-1]]

    def sums(rows):
        g = h = 0.0
        for i in rows:
            p = 1 / (1 + math.exp(-score[i]))
            _, a, b = cells[i]
            g += a * (1 - p) - b * p
            h += (a + b) * p * (1 - p)
        return g, h

    def best(rows):
        g, h = sums(rows)
        top = (0.0, None)
        for k, v in cuts:
            gl, hl = sums([i for i in rows if cells[i][0][k] <= v])
            gain = gl * gl / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g * g / (h + 1)
            if gain > top[0] + 1e-9:
                top = (gain, (k, v))
        return top[1]

    def leaf(rows):
        g, h = sums(rows)
        return round(SHRINK * g / (h + 1), 6)

    def grow(rows, depth):
        cut = best(rows) if depth else None
        if cut is None:
            return leaf(rows)
        k, v = cut
        return (k, v, grow([i for i in rows if cells[i][0][k] <= v], depth - 1), grow([i for i in rows if cells[i][0][k] > v], depth - 1))

    for _ in range(TREES if cells else 0):
        tree = grow(range(len(cells)), 2)
        if not isinstance(tree, tuple):
            break
        trees.append(tree)
        for i, c in enumerate(cells):
            score[i] += value(tree, c[0])
    return [prior, *trees]


def value(tree, features: tuple[int, ...]) -> float:
    """A tree's leaf for a cell."""
    while isinstance(tree, tuple):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def score(models: list[list], f: tuple[int, ...]) -> float:
    """Sum of the models' log-odds for a cell."""
    return sum(m[0] + sum(value(t, f) for t in m[1:]) for m in models)


def calibrate(judged: list[tuple[float, bool, int]]) -> float | None:
    """The score whose calibrated probability is KEEP_AT: Platt scaling on (score,
    positive, rows); None where nothing is positive or higher scores are not likelier."""
    pos, neg = sum(n for _, y, n in judged if y), sum(n for _, y, n in judged if not y)
    if not pos:
        return None
    high, low = (pos + 1) / (pos + 2), 1 / (neg + 2)
    a, b = 1.0, 0.0
    for _ in range(100):
        ga, gb, haa, hab, hbb = 1e-3 * (a - 1), 0.0, 1e-3, 0.0, 1e-6
        for s, y, n in judged:
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, a * s + b))))
            g, h = n * (p - (high if y else low)), n * p * (1 - p)
            ga, gb, haa, hab, hbb = ga + g * s, gb + g, haa + h * s * s, hab + h * s, hbb + h
        det = haa * hbb - hab * hab
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = min(1.0, 1 / max(1e-9, abs(da), abs(db)))
        a, b = a - step * da, b - step * db
    return (math.log(KEEP_AT / (1 - KEEP_AT)) - b) / a if a > 0 else None


def model_column(models: list[list], f: Column) -> Column:
    """The boosted score as a CASE expression."""

    def node(tree) -> Column:
        if not isinstance(tree, tuple):
            return F.lit(tree)
        k, v, left, right = tree
        return F.when(f[FEATURES[k]] <= v, node(left)).otherwise(node(right))

    out = F.lit(sum(m[0] for m in models))
    for tree in (t for m in models for t in m[1:]):
        out = out + node(tree)
    return out


def scan(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """:func:`candidates`, stored."""
    return stored(candidates(docs, keep), "candidates")


def fit(scanned: DataFrame) -> tuple[list[list], float]:
    """(format and context trees, threshold) from all rows of :func:`scan`.

    Rows fall into FOLDS by crc32(doc_id).  Trees of the other folds score each
    fold's cells, and the threshold is calibrated on these scores of all cells; a cell
    is positive if either view says so (a secret often stands bare, and a cue before
    odd text).  The trees that are returned know all cells.  Where the scores of other
    folds do not tell (a cell that one fold alone has, say), the threshold is the least
    score that the returned trees give a positive cell; it is infinite only where no
    candidate of the table is positive.
    """
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS
    counted = scanned.select(fold.alias("fold"), F.explode("wide.f").alias("f")).groupBy("fold", "f").agg(F.count("*").alias("n")).collect()
    cells = sorted((int(r.fold), tuple(r.f), r.n) for r in counted)

    def trained(held: int | None) -> list[list]:
        known: dict[tuple[int, ...], int] = {}
        for k, f, n in cells:
            if k != held:
                known[f] = known.get(f, 0) + n
        return [train([(f, n * label(f), n * (not label(f))) for f, n in sorted(known.items())], view) for view, label in ((FORMAT, context_label), (CONTEXT_VIEW, format_label))]

    def positive(f: tuple[int, ...]) -> bool:
        return context_label(f) or format_label(f)

    models = trained(None)
    folds = {k: trained(k) for k in sorted({k for k, _, _ in cells})}
    threshold = calibrate([(score(folds[k], f), positive(f), n) for k, f, n in cells])
    if threshold is None:
        threshold = min((score(models, f) for _, f, _ in cells if positive(f)), default=math.inf)
    return models, threshold


def find_spans(scanned: DataFrame, model: list[list], threshold: float) -> DataFrame:
    """Rows of :func:`scan` with the base spans by kind, and ``added``: the selected candidates that
    overlap neither a base span nor an earlier or longer selected one."""
    found = scanned
    if threshold == math.inf:
        return found.withColumn("added", F.array().cast("array<struct<kind:string,s:int,e:int>>")).drop("wide")
    picked = F.transform(
        F.filter("wide", lambda c: model_column(model, c["f"]) >= threshold),
        lambda c: F.struct(c["s"].alias("s"), (-c["e"]).alias("e"), c["kind"].alias("kind")),
    )
    none = F.array().cast("array<struct<kind:string,s:int,e:int>>")
    kept = F.aggregate(
        F.array_sort(picked),
        none,
        lambda acc, c: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["e"] > c["s"]), acc).otherwise(F.concat(acc, F.array(F.struct(c["kind"].alias("kind"), c["s"].alias("s"), (-c["e"]).alias("e"))))),
    )
    return found.withColumn("added", F.when(F.size("wide") > 0, kept).otherwise(none)).drop("wide")


def _of(kind: str):
    return lambda s: s["kind"] == kind


def _shown(kind: str):
    return lambda s: F.concat_ws(":", F.lit(kind), s["s"].cast("string"), s["e"].cast("string"))


def _listed(kinds: list[str]) -> Column:
    parts = []
    for kind in kinds:
        spans = F.col(kind) if kind in BASE else F.filter("added", _of(kind))
        parts.append(F.transform(spans, _shown(kind)))
    return F.array_join(F.concat(*parts), ",")


def merged_spans() -> Column:
    """All spans of a row of :func:`find_spans` as sorted disjoint (kind, s, e);
    overlapping ones become one span of the first's kind."""
    every = [F.transform(F.col(k), _tagged(k)) for k in BASE] + [F.transform("added", lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), s["kind"].alias("kind")))]
    none = F.array().cast("array<struct<s:int,e:int,kind:string>>")

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"), last["kind"].alias("kind"))
        touching = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["e"] > x["s"])
        return F.when(touching, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.array_sort(F.concat(*every)), none, step)


def _tagged(kind: str):
    return lambda s: F.struct(s["s"].alias("s"), s["e"].alias("e"), F.lit(kind).alias("kind"))


def redacted_text(text: Column, spans: Column) -> Column:
    """The text with each of (s, e, kind), sorted and disjoint, replaced by <kind>."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substr(text, acc["at"] + 1, s["s"] - acc["at"])
        return F.struct(s["e"].alias("at"), F.concat(acc["out"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out"))

    return F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["at"] + 1, F.length(text))))


def redact(scanned: DataFrame, model: list[list], threshold: float) -> DataFrame:
    """The columns kept by :func:`scan`, ``text`` among them, with every span in
    the text replaced by its kind in angle brackets; null texts stay null, other
    columns stay as they are."""
    found = find_spans(scanned, model, threshold).select("kept", merged_spans().alias("_all"))
    text = F.col("kept.text")
    clean = F.when(F.size("_all") > 0, redacted_text(text, F.col("_all"))).otherwise(text)
    return found.select(*[clean.alias("text") if c == "text" else F.col("kept")[c].alias(c) for c in scanned.schema["kept"].dataType.names])


def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole ``documents`` text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scanned = scan(docs)
    out = find_spans(scanned, *fit(scanned))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return out.select("doc_id", *counts, F.sha2(_listed(list(BASE)), 256).alias("base_sha256"), _listed(list(KINDS)).alias("spans"))
