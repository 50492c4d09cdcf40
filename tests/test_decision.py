"""The decision path against the plain matcher, row by row."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from lexbind import schemas
from lexbind.functions import text as T
from lexbind.functions.similarity import likeness_udf
from lexbind.operators import blocking, evidence, index, lines, matcher, ranking, readings
from tests import plain_matcher as plain

WORDS = "golden meadow riverstone château montbrise domaine aurelle velmora ridge sundara gate pelluna bay wexmere hill orlanto crest casa bluefern old cellar".split()
GRAPES = ["ruvella", "tarnac", "merena noir"]


def products():
    r = random.Random(4)
    out = []
    for k in range(60):
        name = " ".join(r.sample(WORDS, r.randint(1, 3)))
        producer = r.choice([None, "Casa Bluefern", "Domaine Aurelle", name.split()[0] + " estate"])
        out.append({"id": str(100 + k), "name": [name.title()], "producer": [producer] if producer else [], "grapes": r.sample(GRAPES, r.randint(0, 2)), "region": [r.choice(["Norvale", "Estmark"])] if k % 3 else [], "style": [r.choice(["dry", "semi sweet"])], "year": r.choice([None, 2019, 2021])})
    # Equal names of several products.
    out += [{**out[k], "id": str(200 + k)} for k in range(8)] + [{**out[0], "id": "300", "producer": ["Velmora Estate"]}]
    return out


def observations():
    r = random.Random(8)
    rows = {}
    for k, p in enumerate(products()):
        parts = [p["name"][0], *p["producer"], *p["grapes"], *p["style"], str(p["year"] or "")]
        if k % 4 == 1:
            parts = [w for t in parts for w in t.split()]
        if k % 4 == 2:
            parts = parts[: r.randint(1, 3)]
        noisy = []
        for t in parts:
            t = list(t.upper() if k % 2 else t)
            for _ in range(k % 3):
                if len(t) > 4:
                    t[r.randrange(len(t))] = r.choice("aeiln")
            noisy.append("".join(t))
        if k % 5 == 0:
            noisy.insert(r.randrange(len(noisy) + 1), r.choice(["!!", "lot 42", "estate bottled", "wexmere"]))
        rows[f"o{k}"] = [(t, r.choice([None, 0.75, 0.9, 1.0])) for t in noisy]
    rows |= {"none": [("!!!", 1.0)], "odd": [("zzzz", 0.5)], "year": [("2019", 1.0)], "long": [("golden meadow " * 40, 0.9)]}
    return rows


@pytest.fixture(scope="module")
def brute():
    catalog = plain.Catalog(products())
    return catalog, {k: catalog.decide(v) for k, v in observations().items()}


@pytest.fixture(scope="module")
def engine(spark):
    catalog = [(1, p["id"], p["name"][0], (p["producer"] or [None])[0], (p["region"] or [None])[0], p["style"], None, p["grapes"], p["year"], None, None, None, None, None, None) for p in products()]
    ix = matcher.CatalogIndex.build(spark.createDataFrame(catalog, schemas.CATALOG))
    observed = spark.createDataFrame([(k, i, t, c) for k, v in observations().items() for i, (t, c) in enumerate(v)], schemas.LINES)
    parsed = lines.parse_lines(observed).cache()
    queries = lines.query_lines(parsed).cache()
    candidates = blocking.retrieve(queries, ix.tokens, ix.grams, ix.size).cache()
    return ix, observed, parsed, queries, candidates


def test_likeness(spark):
    r = random.Random(2)
    keys = [" ".join("".join(r.choices("aelmrt", k=r.randint(1, 6))) for _ in range(r.randint(0, 4))) for _ in range(120)]
    pairs = [(a, b) for a in keys for b in keys]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", likeness_udf("a", "b").alias("x")).collect()
    for row in got:
        want = plain.likeness(row.a, row.b)
        assert row.x == pytest.approx(want if want >= 0.62 else 0.0, abs=1e-12)
    assert SequenceMatcher(None, "tide", "diet").ratio() != SequenceMatcher(None, "diet", "tide").ratio()


def test_queries(engine):
    got = {}
    for row in engine[3].orderBy("obs_id", "qpos").collect():
        got.setdefault(row.obs_id, []).append((row.text, row.confidence and round(row.confidence, 9), list(row["keys"]), tuple(row.indices)))
    for k, v in observations().items():
        want = [(t, c and round(c, 9), keys, tuple(at)) for t, c, keys, at in plain.composites(plain.lines(v))]
        assert got.get(k, []) == want


def test_candidates(engine, brute):
    got = {}
    for row in engine[4].orderBy("obs_id", "rank").collect():
        got.setdefault(row.obs_id, []).append(row.id)
    catalog, _ = brute
    for k, v in observations().items():
        assert got.get(k, []) == catalog.retrieved(plain.composites(plain.lines(v)))


def shown(e):
    return (e.field, e.ocr_text, e.catalog_key, list(e.ocr_indices), e.similarity, e.weighted_similarity, e.contribution, e.matched_words)


def wanted(e):
    return tuple(e)


def test_evidence_and_scores(engine, brute):
    ix, _, parsed, queries, candidates = engine
    rows = ranking.rank(candidates, ix.catalog, ix.forms, parsed, queries, ix.token_df, ix.size).collect()
    got = {(r.obs_id, r.id): r for r in rows}
    want = {(k, r[0]): r for k, d in brute[1].items() for r in d.scores}
    assert got.keys() == want.keys() and len(got) > 1000
    for key, (_, score, found) in want.items():
        assert [shown(e) for e in got[key].evidence] == [wanted(e) for e in found], key
        assert got[key].match_score == score, key


def test_lines_are_compared_for_scores_that_can_be_shown(engine, brute):
    ix, _, parsed, queries, candidates = engine
    rows = ranking.rank(candidates, ix.catalog, ix.forms, parsed, queries, ix.token_df, ix.size, least=ranking.SHOWN).collect()
    got = {(r.obs_id, r.id): r for r in rows}
    want = {(k, r[0]): r for k, d in brute[1].items() for r in d.scores}
    best = {k: max([r[1] for r in d.scores], default=0.0) for k, d in brute[1].items()}
    assert got.keys() == want.keys()
    for key, (_, score, found) in want.items():
        if best[key[0]] >= ranking.SHOWN:
            assert got[key].match_score == score and [shown(e) for e in got[key].evidence] == [wanted(e) for e in found], key
        else:
            assert got[key].match_score < ranking.SHOWN
    assert max(best.values()) >= ranking.SHOWN


def test_hopeless_lines_are_not_compared(spark):
    head = "one two three four five"
    tails = ["zorgling crumpot blathek", "quistern vaddock hummel", "brindlow stappard ockley"]
    catalog = [(1, str(i), f"{head} {t}", None, None, [], None, [], None, None, None, None, None, None, None) for i, t in enumerate(tails)]
    ix = matcher.CatalogIndex.build(spark.createDataFrame(catalog, schemas.CATALOG))
    observed = spark.createDataFrame([("1", 0, f"{head} {tails[0]}", 0.9), ("2", 0, "three four", 0.9)], schemas.LINES)
    parsed = lines.parse_lines(observed).cache()
    queries = lines.query_lines(parsed).cache()
    candidates = blocking.retrieve(queries, ix.tokens, ix.grams, ix.size).cache()
    every, some = (ranking.rank(candidates, ix.catalog, ix.forms, parsed, queries, ix.token_df, ix.size, least=x).collect() for x in (None, ranking.SHOWN))
    assert {r.obs_id for r in every} == {r.obs_id for r in some} == {"1", "2"}
    assert sorted(r for r in every if r.obs_id == "1") == sorted(r for r in some if r.obs_id == "1")
    assert any(r.evidence for r in every if r.obs_id == "2") and not any(r.evidence for r in some if r.obs_id == "2")


def test_best_evidence_and_spread_titles(engine, brute):
    ix, _, parsed, queries, candidates = engine
    keys = ix.forms.where("field = 'name'").select(F.col("form").alias("key"))
    spec = index.specificity(keys.union(keys.select(F.explode(F.split("key", " ")).alias("key"))), ix.token_df, ix.size)
    catalog, _ = brute
    seen = observations()
    asked = {(r.obs_id, r.id) for r in candidates.select("obs_id", "id").collect()}
    best = {(r.obs_id, r.id, r.field): shown(r.evidence) for r in evidence.best_evidence(candidates, ix.forms, queries, spec).collect()}
    assert best == {(k, i, f): wanted(e) for k, v in seen.items() for (i, f), e in catalog.evidence(plain.composites(plain.lines(v))).items() if (k, i) in asked}
    got = {(r.obs_id, r.id): shown(r.evidence) for r in evidence.spread_titles(candidates, ix.forms, parsed, spec).collect()}
    want = {}
    for k, v in seen.items():
        want |= {(k, i): wanted(e) for i, e in catalog.titles(plain.lines(v)).items() if (k, i) in asked}
    assert got == want and len(got) > 50


def test_decisions(engine, brute):
    ix, observed, *_ = engine
    rows = {r.obs_id: r for r in matcher.resolve(observed, ix).collect()}
    _, want = brute
    assert rows.keys() == want.keys()
    for k, d in want.items():
        r = rows[k]
        assert (r.status, [c.id for c in r.candidates], bool(r.rejection_reason)) == (d.status, d.candidates, d.reason), k
        if r.best_match:
            assert r.best_match.evidence_coverage == d.coverage
    assert len({d.status for d in want.values()}) == 3


def test_consensus(spark):
    """Of accepted passes the largest group of equal texts, else confidence plus agreement."""
    r = random.Random(1)
    rows, want = [], {}
    for crop in range(120):
        passes = []
        for k in range(r.choice([1, 2, 3, 3, 3])):
            text = "".join(r.choice(["Riva", "riva", "Rivo", "Mont", "Monte"]))
            passes.append((k, text, round(r.uniform(0.85, 1), 3), r.random() < 0.75))
        rows += [(1, crop, *p) for p in passes]
        good = [p for p in passes if p[3]]
        groups = {}
        for p in good:
            groups.setdefault(p[1].lower(), []).append(p)

        def near(a, b):
            a, b = a.lower(), b.lower()
            d = list(range(len(b) + 1))
            for i, x in enumerate(a):
                last, d[0] = d[0], i + 1
                for j, y in enumerate(b):
                    last, d[j + 1] = d[j + 1], min(last + (x != y), d[j] + 1, d[j + 1] + 1)
            return 1 - d[-1] / max(len(a), len(b))

        def value(p):
            others = [near(p[1], o[1]) for o in good if o is not p]
            return p[2] + 0.08 * (sum(others) / len(others) if others else 1.0) - 0.001 * len(p[1])

        if not good:
            best = max(passes, key=lambda p: (p[2], -p[0]))
        elif max(map(len, groups.values())) >= 2:
            group = max(groups.values(), key=lambda g: (len(g), g[0][2], -g[0][0]))
            best = max(group, key=lambda p: (p[2], -p[0]))
        else:
            best = max(good, key=lambda p: (value(p), -p[0]))
        want[crop] = (best[1], best[2], bool(good))
    df = spark.createDataFrame(rows, "obs_id int, crop_index int, pass_index int, text string, mean double, accepted boolean")
    assert {r.crop_index: (r.text, r.mean, r.accepted) for r in readings.consensus(df).collect()} == want


def test_confidence_of_first_values(spark):
    """One pass gives all figures; arrays without a value, or with a missing one, give none."""
    rows = [(0, [0.29, 0.9, 0.95], 3), (1, [0.5, 0.1], 1), (2, [], 0), (3, [0.5, None], 2), (4, None, 1)]
    df = spark.createDataFrame(rows, "k int, c array<double>, n int")
    got = {r.k: r.s for r in df.select("k", readings.confidence("c", "n", F.lit(True)).alias("s")).collect()}
    assert (got[0].mean, got[0].least, got[0].percent, got[0].n) == ((0.29 + 0.9 + 0.95) / 3, 0.29, 214, 3)
    assert abs(got[0].quartile - 0.595) < 1e-12 and got[1].quartile == 0.5
    assert all(got[k].mean is None and got[k].percent is None and not got[k].accepted for k in (2, 3, 4))


def test_readings_are_judged_once(spark):
    """Texts are compared only where no two passes agree, and a filter does not judge twice."""
    rows = [(1, 0, p, "monte riva", [0.99] * 9) for p in range(3)]
    good = readings.gated(spark.createDataFrame(rows, "obs_id long, crop_index long, pass_index int, text string, char_conf array<double>"))
    plan = readings.best_by_text(good)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_confidence(") == 1
    picked = readings.consensus(good)
    assert " Join " not in picked._jdf.queryExecution().optimizedPlan().toString() and picked.first().text == "monte riva"


def test_lines_without_visible_characters_have_no_quantile(spark, tmp_path):
    spark.createDataFrame([(1, "\t\nab")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    from lexbind.plans import box_queries

    assert {r.crop_index for r in box_queries.QUERIES["conf_quantile"](spark, str(tmp_path)).collect()} == {1}


def test_split_moves_digests(spark):
    """Whole labels neither meet nor are drawn; both sides of a split share none."""
    from lexbind.operators import sampling

    rows = [(k, f"Label {k % 40}" * 50, "ab"[k % 2]) for k in range(400)]
    split = sampling.grouped_split(spark.createDataFrame(rows, "sample_id long, label string, pool string"), 0.2, 3)
    plan = split.select("sample_id", "fold")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_k#" in plan and "_g#" not in plan
    mixed = split.union(split.where("sample_id = 0").withColumn("fold", F.when(F.col("fold") == "val", "train").otherwise("val")))
    assert sampling.leakage(split).count() == 0 and [r.label for r in sampling.leakage(mixed).collect()] == [rows[0][1].lower()]


def test_coverage_counts_in_place(spark):
    """Hits of a line and a product are counted where the observation is, without a shuffle of them."""
    parsed = lines.parse_lines(spark.createDataFrame([(1, 0, "red mill", 0.9), (1, 1, "red sea", 0.9), (1, 2, "abc", 0.9)], "obs_id long, line_idx long, text string, confidence double"))
    rows = ranking.line_coverage(parsed, spark.createDataFrame([("red", ["a", "b"]), ("mill", ["a"]), ("abc", ["c"])], "token string, ids array<string>").hint("broadcast"))
    assert {r.id: r.evidence_coverage for r in rows.collect()} == {"a": 1.0, "b": 1.0, "c": 0.0}
    assert rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") <= 1


def test_aliases_are_made_once(spark):
    """Reading the aliases does not work them out again in a filter, and distinct
    texts make each key once."""
    from lexbind.functions import text as T
    from lexbind.operators import catalog

    df = spark.createDataFrame([(1, ["Riva", None, "RIVA", "", "Mo", "ri va"])], "id int, v array<string>")
    assert df.select(T.distinct_text("v").alias("d")).first().d == ["Riva", "Mo", "ri va"]
    rows = spark.range(3).select(F.col("id"), F.when(F.col("id") < 2, F.array(F.struct(F.lit("a").alias("text"), F.lit("b").alias("key"), F.lit("name").alias("source")))).alias("aliases"))
    assert catalog.alias_rows(rows).count() == 2 and {(r.source, r.n) for r in catalog.alias_sources(rows).collect()} == {("name", 2)}
    made = catalog.alias_rows(rows.withColumn("aliases", F.transform("aliases", lambda a: a)))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "transform(" in line]


@pytest.mark.parametrize("cells", [blocking.TABLE_CELLS, 0])
def test_lines_stay_where_they_are(spark, monkeypatch, cells):
    """Retrieval from an index that tasks hold moves no line: no join with lines, no
    shuffle of them; terms of two keys count twice; ties go by id; joins agree."""
    monkeypatch.setattr(blocking, "TABLE_CELLS", cells)
    rng = random.Random(7)
    words = ["rosé", "clos", "1234", "a12b4", "château", "ab", "mont", "montagne", "ontario", "брют"]
    names = [(i, "name", 0, 0, " ".join(rng.choices(words, k=3))) for i in range(60)]
    forms = spark.createDataFrame(names, "id long, field string, field_pos int, form_pos int, form string")
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 6))) for _ in range(80)] + ["", "1234", "???"]
    queries = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "obs_id long, t string").select("obs_id", T.forms("t").alias("keys"))
    tokens, grams = index.token_postings(forms), index.gram_postings(forms)
    here = blocking.best_by_line(queries, tokens, grams, 60, 7)
    plan = here._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    there = blocking.best_by_line(queries, tokens, grams, 60, 7, local=0)
    got, want = (sorted((r.obs_id, r["rank"], r.id, r.votes) for r in df.collect()) for df in (here, there))
    assert got == want and len({g[0] for g in got}) > 60


def test_missing_words_meet_once(spark):
    """Rare words are counted from what each product holds; words and products never
    stand beside each other for every observation."""
    parsed = spark.createDataFrame([(1, ["alpha bravo", "alphà bravo"]), (1, ["gamma xx bravo"]), (2, ["delta"]), (3, ["none of these"])], "obs_id long, keys array<string>")
    lists = spark.createDataFrame([("alpha", [7, 8]), ("bravo", [8]), ("gamma", [9]), ("delta", list(range(101)))], "token string, ids array<long>")
    rows = ranking.missing_words(parsed, lists)
    assert sorted((r.obs_id, r.id, r.missing) for r in rows.collect()) == [(1, 7, 2), (1, 8, 1), (1, 9, 2)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_forms_work_a_key_out_in_compiled_code(spark):
    df = spark.createDataFrame([("a",)], "t string").select(T.forms("t").alias("k"))
    assert "filter(" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_observations_that_cannot_be_shown_are_not_compared(spark, monkeypatch):
    """A title's part in one of many lines scores, but explains too few of them; a whole
    title, read as it stands or almost, does not need the others."""
    head, title = "one two three four five", "one two three four five zorgling crumpot blathek"
    catalog = [(1, str(i), t, None, None, [], None, [], None, None, None, None, None, None, None) for i, t in enumerate([title, f"{head} quistern vaddock hummel", f"{head} brindlow stappard ockley"])]
    ix = matcher.CatalogIndex.build(spark.createDataFrame(catalog, schemas.CATALOG))
    rest = ["nothing of this sort", "stands in any of them", "however long one looks", "at lines without end"]
    texts = {"part": ["zorgling crumpot blathek", *rest], "whole": [title, *rest], "almost": [title.replace("crumpot", "crumpat"), *rest], "alone": [title]}
    observed = spark.createDataFrame([(k, i, t, 1.0) for k, v in texts.items() for i, t in enumerate(v)], schemas.LINES)
    asked, best = set(), evidence.best_evidence

    def seen(candidates, *a):
        asked.update(r.obs_id for r in candidates.select("obs_id").distinct().collect())
        return best(candidates, *a)

    monkeypatch.setattr(evidence, "best_evidence", seen)
    rows = {r.obs_id: (r.status, r.best_match and r.best_match.id, len(r.candidates), r.rejection_reason) for r in matcher.resolve(observed, ix).collect()}
    assert asked == {"whole", "almost", "alone"}
    with monkeypatch.context() as m:  # all candidates of all observations
        m.setattr(ranking, "rank_shown", lambda candidates, *a: ranking.rank(candidates, *a))
        assert rows == {r.obs_id: (r.status, r.best_match and r.best_match.id, len(r.candidates), r.rejection_reason) for r in matcher.resolve(observed, ix).collect()}
    assert rows["whole"][:2] == rows["alone"][:2] == ("matched", "0") and rows["part"] == ("unresolved", None, 0, ranking.REASON)


def test_titles_are_read_where_the_lines_are(engine, monkeypatch):
    ix, _, parsed, _, candidates = engine
    keys = ix.forms.where("field = 'name'").select(F.col("form").alias("key"))
    spec = index.specificity(keys.union(keys.select(F.explode(F.split("key", " ")).alias("key"))), ix.token_df, ix.size)

    def rows():
        return {(r.obs_id, r.id): shown(r.evidence) for r in evidence.spread_titles(candidates, ix.forms, parsed, spec).collect()}

    local, joined, calls = rows(), evidence._joined_titles, []
    monkeypatch.setattr(evidence, "LOCAL_TITLES", 0)
    monkeypatch.setattr(evidence, "_joined_titles", lambda *a: calls.append(1) or joined(*a))
    assert rows() == local and len(local) > 50 and calls == [1]


def test_similar_words_by_letters(monkeypatch):
    from lexbind.functions import gestalt
    from lexbind.operators import qgrams

    r = random.Random(3)
    words = sorted({"".join(r.choices("abcdeéñ", k=r.randint(1, 9))) for _ in range(300)} | {"a" * 300, "ab" * 90, "7" * 20, "12"})
    for columns in (qgrams.LETTERS, 3):  # columns that letters share
        monkeypatch.setattr(qgrams, "LETTERS", columns)
        index_, asked = qgrams.WordIndex(words[::2], 0.78), words[1::2] + ["a" * 280, "zz", words[0]]
        place, ids, like = index_.similar(asked)
        got = {(asked[p], index_.words[i]): x for p, i, x in zip(place, ids, like)}
        pairs = [(a, b) for a in asked for b in words[::2]]
        want = dict(zip(pairs, gestalt.ratios(*map(list, zip(*pairs)))))
        assert got == {p: x for p, x in want.items() if x >= 0.78} and len(got) > 20
        reach = gestalt.may_reach(*map(list, zip(*pairs)), 0.6)
        assert all(m or want[p] < 0.6 for p, m in zip(pairs, reach)) and not reach.all()
    empty = qgrams.WordIndex([], 0.78).similar(["abc"])
    assert [len(x) for x in empty] == [0, 0, 0]
