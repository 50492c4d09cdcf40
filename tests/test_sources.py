"""Readers and writers: fetches by key, errors, reports; order statistics with ties."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lexbind.functions import text as T
from lexbind.operators import catalog, evaluation, lexicon
from lexbind.operators.catalog import ConstraintError
from lexbind.sources import readers, writers


def test_fetch_by_key_lists_nothing(spark, tmp_path):
    root = tmp_path / "root"
    (root / "a").mkdir(parents=True)
    (root / "a" / "x.bin").write_bytes(b"one")
    (root / "y z.bin").write_bytes(b"")
    (tmp_path / "secret").write_bytes(b"no")
    rows = [("t1", "a/x.bin"), ("t2", "a/x.bin"), ("t3", "y z.bin"), ("t4", "gone"), ("t5", "../secret"), ("t6", None), ("t7", "a")]
    tasks = spark.createDataFrame(rows, "task_id string, object_key string")
    for where in (str(root), f"file://{root}"):
        got = {r.task_id: None if r.content is None else bytes(r.content) for r in readers.fetch_objects(spark, tasks, where).collect()}
        assert got == {"t1": b"one", "t2": b"one", "t3": b"", "t4": None, "t5": None, "t6": None, "t7": None}


def test_image_paths_and_audit(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt"):
        (tmp_path / name).write_bytes(b"x")
    found = [r.path for r in readers.image_paths(spark, [], str(tmp_path)).orderBy("part", "path").collect()]
    assert [p.rsplit("/", 1)[1] for p in found] == ["a.jpg", "b.PNG"]
    both = readers.image_paths(spark, [found[1], "other.png", "other.png"], str(tmp_path)).orderBy("part", "pos", "path").collect()
    assert [(r.path.rsplit("/", 1)[-1], r.part) for r in both] == [("b.PNG", 0), ("other.png", 0), ("a.jpg", 1)]
    assert [r.path for r in readers.image_paths(spark, [], None, "one.jpg").collect()] == ["one.jpg"]
    with pytest.raises(ConstraintError, match="no file of .ttf"):
        readers.audited_files(spark, str(tmp_path), (".ttf",))


def test_catalog_error_names_the_row(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('﻿{"schema_version":1,"id":"1"}\n\n{"schema_version":1,"id":"2"}\n{broken\n{"schema_version":1,"id":"3"}\n', encoding="utf-8")
    with pytest.raises(ConstraintError, match=r"'row': 4"):
        readers.read_catalog(spark, str(tmp_path / "c.jsonl"))


def test_reports_and_summaries(spark, tmp_path):
    df = spark.createDataFrame([("f", 0.123456, ["a", "b"]), ("g", 1.0, [])], "filename string, coverage double, missing array<string>")
    writers.write_report(df, ["coverage"], str(tmp_path / "report"))
    assert sorted((r.filename, r.coverage, r.missing) for r in spark.read.option("header", True).csv(str(tmp_path / "report/csv")).collect()) == [("f", "0.1235", "a b"), ("g", "1.0000", None)]
    assert {r.filename: (r.coverage, r.missing) for r in spark.read.json(str(tmp_path / "report/json")).collect()} == {"f": (0.123456, ["a", "b"]), "g": (1.0, [])}
    with pytest.raises(Exception, match="already exists"):
        writers.write_report(df, ["coverage"], str(tmp_path / "report"))
    summary = json.loads(writers.run_summary({"fonts": df.groupBy("filename").count().orderBy("filename")}, seed=3))
    assert summary == {"seed": 3, "fonts": [{"filename": "f", "count": 1}, {"filename": "g", "count": 1}]}
    labels = spark.createDataFrame([("a.png", "some\ttext", "latin"), ("b.png", "é", "mixed")], "filename string, label string, pool string")
    writers.write_manifest(labels, str(tmp_path / "labels"))
    assert sorted(tuple(r) for r in readers.read_manifest(spark, str(tmp_path / "labels")).collect()) == sorted(tuple(r) for r in labels.collect())


def test_alias_sources(spark):
    df = spark.createDataFrame([("1", [("a", "a", "name"), ("b", "b", "raw_title")]), ("2", [("c", "c", "name")]), ("3", [])], "id string, aliases array<struct<text:string,key:string,source:string>>")
    assert {r.source: r.n for r in catalog.alias_sources(df).collect()} == {"name": 2, "raw_title": 1}


def test_timing_summary_with_ties(spark):
    r = random.Random(3)
    rows = [(g, 7.0 if r.random() < 0.5 else r.randrange(20) / 2) for g in ("a", "b", None) for _ in range(r.randrange(90, 110))] + [("c", 1.0), ("d", None), ("e", 1.0), ("e", 4.0)]
    got = {x.g: (x.median, x.p95, x.greatest) for x in evaluation.timing_summary(spark.createDataFrame(rows, "g string, v double"), "v", ["g"]).collect()}
    for g in {g for g, v in rows if v is not None}:
        values = sorted(v for h, v in rows if h == g and v is not None)
        n = len(values)
        assert got.pop(g) == ((values[(n - 1) // 2] + values[n // 2]) / 2, values[int(0.95 * (n - 1))], values[-1])
    assert not got


def test_suffixes_by_join_equal_the_list(spark):
    terms = ["dry", "semi dry", "Brut", "é", "-", "", "semi sweet"]
    texts = ["Rosso semi dry", "Rosso, DRY", "dry", "Rosso-brut", "Rosso brutal", "caffé", "x  semi   sweet", None, "", "Rosso. Semi Dry", ",dry"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate([*texts, "Rosso, DRY"])], "k int, t string")
    got = {r.k: r.stripped for r in lexicon.strip_suffixes(rows, "t", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    want = {r.k: r.w for r in rows.select("k", T.strip_suffix("t", terms).alias("w")).collect()}
    assert got == want and got[0] == "Rosso" and len(got) == len(texts) + 1


def test_exact_key_drops_marks_that_stand_apart():
    for text, want in (("x̂y wine", "x y wine"), ("été", "été"), ("का", "क"), ("กำ x", "ก า x"), ("a⃝b", "a b")):
        assert T.exact_key(text) == want


def test_scraped_record_skips_what_says_nothing(spark):
    items = [{"id": 0, "code": "", "name": "", "title": "T", "grape": ["a", "b"], "year": False, "vintage": 0}, {"id": 7, "grape": [], "varieties": "v", "region": {}}, {"id": "0", "sugar": [], "category": "dry"}]
    df = spark.createDataFrame([(k, json.dumps(i)) for k, i in enumerate(items)], "pos int, j string").select("pos", F.parse_json("j").alias("raw"))
    made = catalog.scraped_record("raw", F.col("pos"))
    rows = df.select("pos", *[made[c].alias(c) for c in ("scraped_id", "name", "year", "sugar", "region")], F.to_json(made["grape"]).alias("grape")).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in rows] == [("1", "T", None, None, None, '["a","b"]'), ("7", None, None, None, None, '"v"'), ("0", None, None, "dry", None, None)]


def test_first_filled(spark):
    pages = ['{"items":[],"data":[{"a":1}]}', '{"items":{"a":2},"results":[1,2]}', "[]", '[{"a":3}]', '{"other":[1]}', "null"]
    df = spark.createDataFrame([(p,) for p in pages], "j string")
    assert [r.n for r in df.select(F.size(catalog.first_filled(F.parse_json("j"))).alias("n")).collect()] == [1, 2, 0, 1, 0, 0]
