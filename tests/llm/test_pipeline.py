"""The pipeline's stages on a small corpus: each decision takes effect."""

import random

import pytest

from tests.llm.test_ops import prose

pytest.importorskip("public_tokenizers")


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    good = [(i, prose(i, 90)) for i in range(120)]
    junk = [(1000 + i, " ".join(w + "###" for w in prose(i, 90).split())) for i in range(40)]
    copies = [(2000 + i, good[i][1]) for i in range(10)]
    items = [(i, prose(9000 + i, 35)) for i in range(5)]
    leaks = [(3000 + i, prose(8000 + i, 60) + " " + items[i][1]) for i in range(5)]
    private = [(4000 + i, prose(7000 + i, 60) + f" me{i}@mail.example.com " + prose(7100 + i, 20)) for i in range(5)]
    rows = good + junk + copies + leaks + private + [(5000, None), (5001, "short")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i < 1000), 0) for i, _ in good + junk], "doc_id long, quality int, toxic int")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    seen, df = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        df.write.parquet(f"{tmp_path}/{name}")
        df = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id for r in df.select("doc_id").collect()}
        if name != "pieces":
            assert df.columns == docs.columns
    ids = lambda part: {i for i, _ in part}
    assert len(seen["quality"] & ids(junk)) <= 2 and len(ids(good) - seen["quality"]) <= 2 and not seen["quality"] & {5000, 5001}
    assert not seen["near_duplicates"] & ids(copies) and seen["near_duplicates"] == seen["quality"] - ids(copies)
    assert seen["leaks"] == seen["near_duplicates"] - ids(leaks)
    texts = {r.doc_id: r for r in spark.read.parquet(f"{tmp_path}/personal_data").collect()}
    for i, _ in private:
        assert "<email>" in texts[i].text and "@" not in texts[i].text and texts[i].n_chars == len(texts[i].text)
    assert seen["pieces"] == seen["personal_data"] == seen["leaks"]
    assert df.where("not round_trip").count() == 0
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == seen["pieces"]


def test_pipeline_edges(spark, tmp_path):
    """Empty tables, null ids and texts, repeated ids and rows, extra columns with the stages' own names."""
    import corpus_pipeline

    extra = "kept int, quality int, item_ids int, share int, wide int, tag int, n int, stay int, _k0 int, doc int"
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    a, b, c = prose(1, 90), prose(2, 90), prose(3, 90)
    rows = [(1, a), (1, a), (1, b), (2, b), (None, c), (None, c), (None, None), (3, None), (4, ""), (5, prose(4, 3000))]
    full = [(*r, "en", None, None, *range(10)) for r in rows]
    for name, data, marks in (("all", full, [(1, 1, 0), (None, 0, 1), (2, None, None)]), ("none", [], [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        df = docs
        for _, stage in corpus_pipeline.STAGES[:-1]:
            df = stage(spark, df, folder)
            assert df.columns == docs.columns
        got = sorted((str(r.doc_id), r.text) for r in df.collect())
        assert got == (sorted([("1", a), ("1", b), ("None", c), ("5", prose(4, 3000))]) if data else [])
        assert corpus_pipeline.run(spark, folder).count() == len(got)
