"""Text functions, matching, boxes, readings, catalogs, sampling, sources, streaming."""

import json
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexbind import schemas
from lexbind.functions import text as T
from lexbind.functions.similarity import edit_similarity, likeness, likeness_udf, may_match, rounded
from lexbind.operators import blocking, boxes, catalog, evaluation, lines, matcher, readings, sampling
from lexbind.sources import readers, writers
from lexbind.streaming import worker


def one(spark, make, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values)))).select(make(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()
    return row.x


@pytest.mark.parametrize("raw, want", [("FROZEN—ROSÉ", "frozen rosé"), ("Розовое Ёж", "розовое еж"), ("Straße", "strasse"), (None, ""), ("a​b c", "a b c"), ("  ", "")])
def test_keys(spark, raw, want):
    assert one(spark, T.key, raw) == T.exact_key(raw) == want


def test_forms(spark):
    assert one(spark, T.forms, "Château") == ["château", "chateau"]
    assert one(spark, T.forms, "plain") == ["plain"] and one(spark, T.forms, "!!") == []
    assert T.exact_accentless(T.exact_key("Ærøskøbing Łódź й")) == "aeroskobing lodz й"


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=30))
def test_key_is_idempotent(t):
    assert T.exact_key(T.exact_key(t)) == T.exact_key(t)


def test_exact_forms_udf(spark):
    r = spark.createDataFrame([("Café ①",)], "t string").select(T.exact_forms("t").alias("f")).first().f
    assert (r.display, r.key, r.accent) == ("Café ①", "café 1", "cafe 1")


def test_text_rules(spark):
    assert one(spark, T.collapse_repeats, "2024 2024 – – Riva riva!") == "2024 – – Riva"
    assert one(spark, T.years, "in 1999, 12001 and 2020x2021") == ["1999", "2020", "2021"]
    assert [one(spark, T.catalog_year, y) for y in ("2019", "2019г", "1899", None)] == [2019, None, None, None]
    assert one(spark, T.has_run, "жЖжж") and not one(spark, T.has_run, "жжж")
    assert not one(spark, T.plausible, "100") and one(spark, T.plausible, "Casa 12") and not one(spark, T.plausible, "IIII") and not one(spark, T.plausible, "日本語")
    assert one(spark, lambda c: T.chunk_phrase(c, 12), "alpha beta gamma, delta averyveryverylongword eta") == ["alpha beta", "gamma", "delta", "eta"]
    assert one(spark, lambda c: T.strip_suffix(c, ["dry", "semi dry"]), "Monte Rosso, SEMI dry") == "Monte Rosso"
    assert one(spark, lambda n, s: T.without_style(n, F.array(s)), "Monte Rosso dry", "Dry") == "Monte Rosso"
    assert one(spark, T.name_from_slug, "monte-rosso_2") == "monte rosso 2" and one(spark, T.name_from_slug, "a/b-c") is None
    assert one(spark, T.lexicon_clean, "“Monte” – Rosso (x") == "Monte - Rosso x"
    assert one(spark, T.trigrams, "abcd abc 1234") == ["abc", "bcd"]
    assert one(spark, T.script, "aж") == "mixed" and one(spark, T.script, "12") == "numeric" and one(spark, T.lexicon_script, "×") == "latin"
    assert one(spark, lambda c: T.distinct_text(F.split(c, ";")), "Riva;RIVA;Mo;ri va") == ["Riva", "Mo", "ri va"]
    assert one(spark, T.url_suffix, "https://x.org/a/b.JPG?x=1") == ".jpg"


def test_suffix_and_style_rules(spark):
    strip = lambda t, *terms: one(spark, lambda c: T.strip_suffix(c, list(terms)), t)
    assert strip("Casa Semidry", "dry") == "Casa Semi" and strip("dry", "dry") == "dry" and strip("Monte dry Rosso", "dry") == "Monte dry Rosso"
    assert strip("Casa, semi-dry", "dry", "Semi-Dry") == "Casa" and strip("Casa.Dry", "dry") == "Casa"
    style = lambda t, *terms: one(spark, lambda c: T.without_style(c, F.array(*map(F.lit, terms))), t)
    assert style("Monte Rosso semi dry", "dry", "semi dry") == "Monte Rosso" and style("Abc dry", "dry") is None
    assert style("Mon semi dry", "dry", "semi dry") == "Mon semi"  # the longer style leaves too little
    assert style("Monte Rosso – dry", "Dry") == "Monte Rosso" and style("Monte: dry", "dry") == "Monte:"
    assert one(spark, T.name_from_slug, "/monte-rosso-bianco/") == "monte rosso bianco" and one(spark, T.name_from_slug, "abc") is None
    assert one(spark, T.lexicon_clean, "Rosso; bianco! (a) d’oro?") == "Rosso bianco (a) d’oro"
    assert one(spark, lambda c: T.chunk_phrase(c, 12), "-x-") == ["x"] and one(spark, lambda c: T.chunk_phrase(c, 12), "...") == []
    assert one(spark, lambda c: T.chunk_phrase(c, 6), "alpha, (be; gamma") == ["alpha", "be", "gamma"]
    assert one(spark, T.safe_name, "a b/ç-1") == "a_b_ç-1"


def test_accents_by_character():
    """Every letter alone and after others: marks go from Latin letters only."""
    import unicodedata

    for ch in map(chr, range(0x80, 0x2000)):
        if unicodedata.category(ch) == "Cn":
            continue
        k = T.exact_key("a" + ch)
        want, latin = "", False
        for c in unicodedata.normalize("NFKD", k.translate(str.maketrans(T.UNDECOMPOSED))):
            if unicodedata.category(c)[0] == "M":
                want += "" if latin else c
            else:
                latin, want = "LATIN" in unicodedata.name(c, ""), want + c
        assert T.exact_accentless(k) == T.exact_key(unicodedata.normalize("NFC", want)), hex(ord(ch))


def test_running(spark):
    from lexbind.operators.order import running

    r = random.Random(3)
    rows = [(r.choice(["a", "b", None]), r.randrange(50), k) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, o int, k int").repartition(7)
    got = running(df, ["g"], ["o", "k"], at=F.lit(1), before=F.col("o")).collect()
    for group in ("a", "b", None):
        mine = sorted((x.o, x.k, x.at, x.before) for x in got if x.g == group)
        assert [x[2] for x in mine] == list(range(len(mine)))
        assert [x[3] for x in mine] == [sum(y[0] for y in mine[:i]) for i in range(len(mine))]
    assert len(got) == 400 and running(df.limit(0), [], ["k"], at=F.lit(1)).count() == 0


def test_catalog_details(spark):
    raw = {"scraped_id": "7", "name": "Monte Rosso dry", "sugar": "dry", "raw_metadata": {"title": "Rosso X dry"}, "detailed_metadata": {"alcohol": "12.5", "slug": "monte-rosso", "title": "Monte Rosso dry"}}
    row = catalog.build_catalog(spark.createDataFrame([(json.dumps(raw),)], "j string").select(F.parse_json("j").alias("raw"))).first()
    assert row.alcohol_percent is None and row.search_text == "Monte Rosso dry | dry"
    assert [(a.source, a.text) for a in row.aliases] == [("name", "Monte Rosso dry"), ("raw_title", "Rosso X dry"), ("name_without_style", "Monte Rosso")]
    items = [{"code": "c1", "title": "T", "winery": "W", "vintage": 2019, "image": "https://x.org/a.JPG?s=1", "rating": 4}, {"name": "N", "producer": "P"}]
    df = spark.createDataFrame([(k, json.dumps(i)) for k, i in enumerate(items)], "pos int, j string").select("pos", F.parse_json("j").alias("raw"))
    out = df.select(*[c.alias(k) for k, c in catalog.scraped_record("raw", F.col("pos")).items()]).orderBy("scraped_id").collect()
    assert [(r.scraped_id, r.name, r.producer, r.year, r.rating, r.local_name) for r in out] == [("2", "N", "P", None, None, None), ("c1", "T", "W", "2019", "4", "wine_c1.jpg")]
    base = spark.createDataFrame([("1", "a")], "id string, name string")
    both = catalog.with_additions(base, spark.createDataFrame([("manual:1", "b", 5)], "id string, name string, year int"))
    assert [(r.id, r.year) for r in both.orderBy("_part").collect()] == [("1", None), ("manual:1", 5)]


def test_enriched_and_checked(spark, ix):
    observed = spark.createDataFrame([("o", 0, "Château Montbrise", 1.0)], schemas.LINES)
    got = worker.enriched(matcher.resolve(observed, ix), ix.catalog).first()
    assert got.best_match.grapes == ["tarnac"] and got.candidates[0].grapes == ["tarnac"]
    assert got.candidates[0].match_score > 0 and got.candidates[0].evidence and "evidence_coverage" in got.best_match
    # The catalog's value wins; a candidate that it lacks stays as it is.
    other = ix.catalog.where("id <> %r" % got.best_match.id).union(ix.catalog.where("id = %r" % got.best_match.id).withColumn("name", F.lit("Other name")))
    decided = matcher.resolve(observed, ix)
    assert worker.enriched(decided, other).first().best_match.name == "Other name"
    lone = worker.enriched(decided, ix.catalog.where("id = 'none'")).first().best_match
    assert lone.name == got.best_match.name and lone.grapes is None and lone.match_score == got.best_match.match_score
    with pytest.raises(catalog.ConstraintError):
        matcher.resolve(spark.createDataFrame([("o", 0, "x", float("nan"))], schemas.LINES), ix)
    # Text that is not composed matches with the exact normaliser on both sides.
    rows = [(1, "5", "Cha\u0302teau Vérité", None, None, [], None, [], None, None, None, None, None, None, None)]
    exact = matcher.CatalogIndex.build(spark.createDataFrame(rows, schemas.CATALOG), exact_text=True)
    assert [r.form for r in exact.forms.orderBy("form_pos").collect()] == ["château vérité", "chateau verite"]
    assert matcher.resolve(spark.createDataFrame([("o", 0, "CHA\u0302TEAU VÉRITÉ", 1.0)], schemas.LINES), exact, exact_text=True).first().best_match.id == "5"


def test_equivalents(spark, ix):
    """A word's equivalent counts at a lower confidence where nothing else was read."""
    from lexbind.operators import evidence

    parsed = lines.parse_lines(spark.createDataFrame([("o", 0, "golden prairie", 1.0), ("o", 1, "zzz", 0.5), ("o", 2, "meadow", 0.8)], schemas.LINES))
    words = spark.createDataFrame([("prairie", "meadow"), ("zzz", "ridge")], "word string, alternate string")
    seen = {r.word: (r.line_idx, round(r.confidence, 3)) for r in evidence.observed_words(parsed, words).collect()}
    assert seen["ridge"] == (1, 0.46) and seen["meadow"] == (0, 0.92) and seen["golden"] == (0, 1.0)


def test_label_folders_and_objects(spark, tmp_path):
    for name in ("Some text_latin-1.png", "no underscore.png", "Riva_x.PNG"):
        (tmp_path / name).write_bytes(b"x")
    rows = readers.read_labels(spark, str(tmp_path), (".png",)).orderBy("filename").collect()
    assert [(r.label, r.pool) for r in rows] == [("Riva", "unknown"), ("Some text", "latin")]
    (tmp_path / "labels.tsv").write_text("filename\tlabel\tpool\na.png\tA\tlatin\n")
    assert [(r.label, r.pool) for r in readers.read_labels(spark, str(tmp_path), (".png",)).collect()] == [("A", "latin")]
    tasks = spark.createDataFrame([("t1", "Riva_x.PNG"), ("t2", "gone")], "task_id string, object_key string")
    got = {r.task_id: r.content for r in readers.fetch_objects(spark, tasks, str(tmp_path)).collect()}
    assert bytes(got["t1"]) == b"x" and got["t2"] is None
    assert readers.fetch_objects(spark, tasks.where("task_id = 't2'"), str(tmp_path)).first().content is None
    found = readers.list_files(spark, str(tmp_path), (".png",))
    explicit = found.where("path like '%Riva%'").select("path", F.lit(0).alias("pos"))
    assert readers.first_paths(explicit, found).where("part = 0").count() == 1 and readers.first_paths(explicit, found).count() == 3


def test_font_pools(spark):
    rows = [("f", "english", 1.0), ("f", "french", 1.0), ("f", "cyrillic", 1.0), ("g", "english", 1.0), ("g", "french", 0.5), ("g", "cyrillic", 0.0)]
    df = spark.createDataFrame(rows, "filename string, set_name string, coverage double")
    assert sorted((r.pool, r.filename) for r in evaluation.font_pools(df).collect()) == [("cyrillic", "f"), ("french", "f"), ("latin", "f"), ("latin", "g"), ("multilingual", "f")]


def test_rounding_is_binary(spark):
    rows = spark.createDataFrame([(2.675, 2.67), (0.8125, 0.812), (0.0125, 0.013)], "x double, n double").select(rounded("x", 3).alias("a"), rounded("x", 2).alias("b")).collect()
    assert [(r.a, r.b) for r in rows] == [(round(x, 3), round(x, 2)) for x in (2.675, 0.8125, 0.0125)]


@settings(max_examples=150, deadline=None)
@given(st.text("abc ", min_size=0, max_size=12), st.text("abc ", min_size=0, max_size=12))
def test_likeness_bounds(a, b):
    a, b = " ".join(a.split()), " ".join(b.split())
    assert 0 <= likeness(a, b) <= 1 and likeness(a, a) == 1


def test_may_match_loses_nothing(spark):
    r = random.Random(3)
    words = ["mon", "monte", "rosso", "ros", "riva", "ri"]
    pairs = [(" ".join(r.choices(words, k=r.randint(1, 4))), " ".join(r.choices(words, k=r.randint(1, 4)))) for _ in range(400)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", may_match(F.col("a"), F.col("b")).alias("may"), likeness_udf("a", "b").alias("like")).collect()
    assert all(r.may for r in rows if r["like"] >= 0.62)


def test_edit_similarity_is_symmetric(spark):
    df = spark.createDataFrame([("Riva", "Rivä"), ("", ""), ("a", ""), ("Mo-nte", "monte")], "a string, b string")
    assert [r[0] for r in df.select(edit_similarity("a", "b")).collect()] == [r[0] for r in df.select(edit_similarity("b", "a")).collect()] == [0.75, 1.0, 0.0, 1.0]


PRODUCTS = [
    ("1289", "Golden Meadow", "Casa Bluefern", "ruvella"), ("1640", "Golden Meadow", "Casa Bluefern", "tarnac"), ("19", "Golden Meadow Riverstone", None, None),
    ("21", "Château Montbrise", "Domaine Aurelle", "tarnac"), ("30", "Orlanto Crest", None, "tarnac"), ("31", "Velmora Ridge", None, "tarnac"), ("32", "Sundara Gate", None, "tarnac"), ("33", "Pelluna Bay", None, "tarnac"), ("34", "Wexmere Hill", None, "tarnac"),
]


@pytest.fixture(scope="module")
def ix(spark):
    rows = [(1, i, n, p, None, [], None, [g] if g else [], None, None, None, None, None, None, None) for i, n, p, g in PRODUCTS]
    return matcher.CatalogIndex.build(spark.createDataFrame(rows, schemas.CATALOG))


@pytest.fixture(scope="module")
def decided(spark, ix):
    obs = {
        "twins": ["GOLDEN MEADOW", "Casa Bluefern"], "longer": ["Golden Meadow", "Riverstone"], "accent": ["Chateau Montbrise"], "bare": ["tarnac", "2019"],
        "noise": ["!!!"], "spread": ["Chateau", "xq", "Montbrise", "Domaine Aurelle"],
    }
    rows = [(k, i, t, 1.0) for k, v in obs.items() for i, t in enumerate(v)]
    return {r.obs_id: r for r in matcher.resolve(spark.createDataFrame(rows, schemas.LINES), ix).collect()}


def test_decisions(decided):
    twins = decided["twins"]
    assert twins.status == "ambiguous" and [c.id for c in twins.candidates[:2]] == ["1289", "1640"]  # string order
    assert twins.candidates[0].match_score == twins.candidates[1].match_score == 0.85  # .65 + .18 + .02
    assert decided["longer"].best_match.id == "19"
    assert decided["accent"].status == "matched" and decided["accent"].best_match.id == "21"
    assert decided["bare"].status == "unresolved" and decided["bare"].candidates == [] and decided["bare"].rejection_reason
    assert decided["noise"].status == "unresolved" and decided["noise"].rejection_reason is None and decided["noise"].ocr_lines == []
    assert decided["spread"].best_match.id == "21" and decided["spread"].status == "matched"


def test_composites(spark):
    rows = [("a", i, t, c) for i, (t, c) in enumerate([("first line", 1.0), ("xx", None), ("third line", 0.8), ("last", 0.6)])]
    parsed = lines.parse_lines(spark.createDataFrame(rows, schemas.LINES))
    got = [(r.text, r.confidence and round(r.confidence, 3), list(r.indices)) for r in lines.query_lines(parsed).orderBy("qpos").collect()]
    assert got[4:] == [("first line xx", None, [0, 1]), ("xx third line", None, [1, 2]), ("third line last", 0.7, [2, 3]), ("first line xx third line", None, [0, 1, 2]), ("xx third line last", None, [1, 2, 3]), ("first line third line", 0.9, [0, 2]), ("first line third line last", 0.8, [0, 2, 3])]
    bad = spark.createDataFrame([("a", 0, "t", float("nan")), ("a", 1, "t", -0.1), ("a", 2, None, 1.0), ("a", 3, "t", None)], schemas.LINES)
    assert lines.invalid_lines(bad).count() == 3


def test_blocking_finds_the_best(spark, ix):
    parsed = lines.parse_lines(spark.createDataFrame([("a", 0, "Montbrize", 1.0)], schemas.LINES))
    got = blocking.retrieve(lines.query_lines(parsed), ix.tokens, ix.grams, ix.size).collect()
    assert [r.id for r in got if r["rank"] == 1] == ["21"]


def test_boxes(spark):
    rect = lambda *v: dict(zip(("x1", "y1", "x2", "y2"), map(float, v)))
    rows = [("a", 0, rect(0, 0, 100, 20)), ("a", 1, rect(2, 0, 100, 20)), ("a", 2, rect(104, 1, 180, 21)), ("a", 3, rect(0, 60, 50, 80)), ("b", 0, rect(0, 0, 5, 5))]
    df = spark.createDataFrame(rows, f"obs_id string, box_id int, r {boxes.RECT}")
    kept = {(r.obs_id, r.box_id) for r in boxes.suppress(df).collect()}
    assert kept == {("a", 0), ("a", 2), ("a", 3), ("b", 0)}
    assert boxes.suppress(boxes.suppress(df)).count() == len(kept)  # a fixpoint
    joined = boxes.fragment_groups(boxes.suppress(df)).collect()
    assert [(r.obs_id, r.r.x1, r.r.x2) for r in joined] == [("a", 0.0, 180.0)]


def test_readings(spark):
    rows = [("a", 0, 0, "Riva", [0.95] * 4), ("a", 0, 1, "riva", [0.9] * 4 + [0.1]), ("a", 0, 2, "Rlva", [0.99] * 4), ("a", 1, 0, "Mon te", [0.99, 0.99, 0.4, 0.99, 0.99]), ("b", 0, 0, "Riva", [0.9] * 4)]
    gated = readings.gated(spark.createDataFrame(rows, schemas.READINGS))
    flags = {(r.obs_id, r.crop_index, r.pass_index): r.accepted for r in gated.collect()}
    assert flags == {("a", 0, 0): True, ("a", 0, 1): True, ("a", 0, 2): True, ("a", 1, 0): False, ("b", 0, 0): True}
    best = {(r.obs_id, r.crop_index): (r.text, r.accepted) for r in readings.consensus(gated).collect()}
    assert best == {("a", 0): ("Riva", True), ("a", 1): ("Mon te", False), ("b", 0): ("Riva", True)}
    assert readings.best_by_text(readings.consensus(gated)).count() == 2
    q = spark.createDataFrame([([0.5, 0.9, 0.95],)], "c array<double>").select(readings.quantile(F.col("c"), 0.25)).first()[0]
    assert abs(q - 0.7) < 1e-12


def test_catalog_constraints(spark, tmp_path):
    good = {"schema_version": 1, "id": "7", "name": "Riva", "style": [], "grapes": [], "aliases": []}

    def write(name, *rows):
        (tmp_path / name).write_text("﻿" + "\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows), encoding="utf-8")
        return str(tmp_path / name)

    assert readers.read_catalog(spark, write("ok", good, "", good | {"id": "8"})).count() == 2
    for k, rows in enumerate(([good, good], [good | {"schema_version": 2}], [good | {"id": None}], ["{bad"], [""])):
        with pytest.raises(catalog.ConstraintError):
            readers.read_catalog(spark, write(f"bad{k}", *rows))
    assert readers.read_objects(spark, write("empty", json.dumps({"items": [], "results": [{"a": 1}]}))).count() == 0
    wrapped = write("wrapped", json.dumps({"items": 5, "results": [{"a": 1}, 3]}))
    assert readers.read_objects(spark, wrapped).count() == 1
    with pytest.raises(catalog.ConstraintError):
        readers.read_list(spark, wrapped)


def test_tables_and_writers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿a,b,c\n 1 ,,x\n", encoding="utf-8")
    rows = readers.read_table(spark, str(tmp_path / "t.csv"), ["a", "b"])
    assert [tuple(r) for r in rows.collect()] == [("1", "")]
    with pytest.raises(catalog.ConstraintError):
        readers.read_table(spark, str(tmp_path / "t.csv"), ["z"])
    out = str(tmp_path / "out")
    writers.write_json(rows, out)
    with pytest.raises(Exception, match="(?i)exists"):
        writers.write_json(rows, out)
    with pytest.raises(ValueError):
        writers.write_merged(rows, out, out)
    (tmp_path / "p.txt").write_text("Riva\nRiva\nx\n a/b . \n", encoding="utf-8")
    phrases = readers.read_phrases(spark, str(tmp_path / "p.txt"))
    assert {r.phrase for r in phrases.collect()} == {"Riva", "a b"}
    assert writers.write_phrases(phrases, str(tmp_path / "ph")) == 2


def test_merge_keeps_ids(spark):
    fresh = spark.createDataFrame([("b",), ("a",), ("c",)], "slug string")
    first = catalog.assign_ids(fresh.where("slug <> 'a'"), spark.createDataFrame([], "slug string, assigned_id long"), "slug", 100)
    again = {r.slug: r.assigned_id for r in catalog.assign_ids(fresh, first, "slug", 100).collect()}
    assert again == {"b": 100, "c": 101, "a": 102}


def test_sampling(spark):
    pools = spark.createDataFrame([(0, "a", 0.4), (1, "b", 0.4), (2, "c", 0.1), (3, "d", 0.1)], "pos int, pool string, ratio double")
    for total in (1, 7, 99, 1000):
        assert sum(r["count"] for r in sampling.largest_remainder(pools, total).collect()) == total
    samples = spark.createDataFrame([(i, f"Word{i % 40}" if i % 2 else f"word{i % 40}", "ab"[i % 40 % 2]) for i in range(400)], "sample_id long, label string, pool string")
    split = sampling.grouped_split(samples, 0.2, 3)
    assert sampling.leakage(split).count() == 0 and 0 < split.where("fold = 'val'").count() < 200
    seed = spark.range(1).select(sampling.item_seed(F.lit(1), F.lit("j"), F.lit("n"))).first()[0]
    import hashlib

    assert int(seed) == int.from_bytes(hashlib.sha256(b"1|j|n").digest()[:8], "little")


def test_evaluation(spark):
    rows = spark.createDataFrame([("müde", "mude", 0.5, "a"), ("x", "X", 1.0, "b")], "label string, prediction string, confidence double, pool string")
    out = {r.pool: r for r in evaluation.error_rates(rows).collect()}
    assert out[None].cer == 0.4 and out["b"].casefold_exact_match == 1.0 and out["a"].exact_match == 0.0


def test_entry_points():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 80


def test_whole_lines_are_resolved(spark, tmp_path):
    from lexbind.plans import box_queries, match_queries

    head = "one two three four five"
    items = [(1, f"{head} zorgling crumpot blathek"), (2, f"{head} quistern vaddock hummel")]
    docs = [(10 + i, f"{text}\nother words") for i, (_, text) in enumerate(items)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.obs_id: r.id for r in match_queries.QUERIES["resolve_documents"](spark, str(tmp_path)).collect()}
    assert found == {10: "1", 11: "2"}
    read = {(r.obs_id, r.crop_index): r.text for r in box_queries.QUERIES["consensus_pick"](spark, str(tmp_path)).collect()}
    assert len(read[10, 0].split()) == len(read[11, 0].split()) == 8


def test_queries_are_read_without_a_session():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) > 100, out.stderr[-500:]
