"""The queue, the worker and the compared pairs: restarts, repeats, failures."""

import json
import math

import pytest
from pyspark.sql import functions as F

from lexbind.streaming import queue, worker


def messages(spark, rows, start=0):
    """(value, at, k) of (task_id, object_key) or raw strings."""
    values = [(start + k, r if isinstance(r, str) else json.dumps({"task_id": r[0], "object_key": r[1]})) for k, r in enumerate(rows)]
    return spark.createDataFrame(values, "k long, value string").withColumn("at", F.timestamp_seconds(F.col("k") + 1_700_000_000))


def lines_of(spark, rows):
    known = spark.createDataFrame(rows, "object_key string, line_idx int, text string, confidence double")
    return lambda objects: objects.join(known, "object_key").withColumnRenamed("object_key", "obs_id")


def count(observed):
    return observed.groupBy("obs_id").agg(F.lit("answered").alias("status"), F.count("*").cast("string").alias("result"))


def drain(run):
    try:
        run.processAllAvailable()
    finally:
        run.stop()


def test_queue_restarts_in_the_middle(spark, tmp_path, monkeypatch):
    """Batches of the prefetch's size; a restart loses and repeats nothing."""
    monkeypatch.setattr(queue, "SEGMENT", 7)
    folder, seen = str(tmp_path / "queue"), []
    assert queue.publish(messages(spark, [(f"t{k}", "a") for k in range(25)]), folder, "k") == 25

    def consume(stop_after):
        def batch(rows, _):
            got = sorted(r.seq for r in rows.collect())
            if stop_after and len(seen) >= stop_after:
                raise RuntimeError("stopped")
            seen.append(got)

        return queue.consume(spark, folder, 10).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "progress")).start()

    with pytest.raises(Exception):
        drain(consume(1))
    assert seen == [list(range(10))]
    drain(consume(0))
    assert sum(seen, []) == list(range(25)) and max(map(len, seen)) == 10
    # Later messages go on from there, also for a query that starts anew.
    assert queue.publish(messages(spark, [("x", "a")] * 3, 25), folder, "k") == 28
    drain(consume(0))
    assert sum(seen, []) == list(range(28))
    assert queue.acknowledged(folder) > 0
    assert queue.publish(messages(spark, []), folder, "k") == 28


def test_each_task_is_answered_once(spark, tmp_path):
    rows = [("t1", "k1"), ("t2", "gone"), "{broken", '{"task_id":"t9"}', '{"task_id":5,"object_key":"k1"}', ("t1", "k2"), ("t3", "nan"), ("t4", "k1")]
    later = [("t1", "k2"), ("t5", "k2"), ("t3", "k1"), ("t2", "k1")]
    folder = str(tmp_path / "queue")
    known = lines_of(spark, [("k1", 0, "a", 1.0), ("k1", 1, "b", None), ("k2", 0, "a", 0.5), ("nan", 0, "a", math.nan), ("nan", 1, "b", 1.0)])
    for part, at in ((rows, 0), (later, len(rows))):
        queue.publish(messages(spark, part, at), folder, "k")
        drain(worker.start(queue.consume(spark, folder, 100), known, count, str(tmp_path / "out"), str(tmp_path / "progress")))
        drain(worker.start_dead_letters(queue.consume(spark, folder, 100, "dead"), str(tmp_path / "dead"), str(tmp_path / "progress-dead")))
    got = sorted((r.task_id, r.object_key, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("t1", "k1", "answered"), ("t2", "gone", "error"), ("t3", "nan", "error"), ("t4", "k1", "answered"), ("t5", "k2", "answered")]
    error = json.loads(spark.read.parquet(str(tmp_path / "out")).where("task_id = 't2'").first().result)
    assert error["status"] == "error" and error["error"] == "recognition_failed" and error["candidates"] == []
    dead = sorted((r.seq, r.reason) for r in spark.read.parquet(str(tmp_path / "dead")).collect())
    assert dead == [(2, "not JSON"), (3, "no object_key"), (4, "no task_id")]


def test_repeated_batch_replaces_its_answers(spark, tmp_path):
    """A batch that fails after its answers are written is answered once."""
    folder, out, fail = str(tmp_path / "queue"), str(tmp_path / "out"), [True]
    queue.publish(messages(spark, [("t1", "k1"), ("t2", "k1")]), folder, "k")
    known = lines_of(spark, [("k1", 0, "a", 1.0)])
    drain(worker.start(queue.consume(spark, folder, 100), known, count, out, str(tmp_path / "progress")))
    commits = tmp_path / "progress" / "commits"
    for f in list(commits.iterdir()):
        f.unlink()  # as if the batch had not been committed
    drain(worker.start(queue.consume(spark, folder, 100), known, count, out, str(tmp_path / "progress")))
    assert fail and sorted(r.task_id for r in spark.read.parquet(out).collect()) == ["t1", "t2"]


def test_failing_object_stands_alone(spark, tmp_path):
    known = lines_of(spark, [(f"k{i}", 0, "bad" if i == 3 else "good", 1.0) for i in range(8)])
    tasks = spark.createDataFrame([(f"t{i}", i, f"k{i}") for i in range(8)], "task_id string, seq long, object_key string")

    def read(frames):
        for frame in frames:
            if (frame["text"] == "bad").any():
                raise ValueError("no")
            yield frame

    def fragile(observed):
        return count(observed.mapInPandas(read, observed.schema))

    parts = worker.isolated(tasks, lambda t: worker.answers(t, known, fragile))
    got = {r.task_id: r.status for part in parts for r in part.collect()}
    assert got == {f"t{i}": "error" if i == 3 else "answered" for i in range(8)}


def test_stream_resolves_every_event(spark, tmp_path):
    from lexbind.plans import stream_queries

    events = [3, 4, 14, 23, 58, 64, 75, 86, 90, 91, 92, 1234, 99999]
    spark.createDataFrame([(64, "alpha beta gamma"), (34, "delta epsilon")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "alpha beta gamma"), (2, "delta epsilon zeta")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(e,) for e in events], "event_id long").coalesce(2).write.parquet(f"{tmp_path}/events.parquet")
    out = {r.task_id: r.status for r in stream_queries.QUERIES["stream_resolve"](spark, str(tmp_path)).collect()}
    assert set(out) == {f"t{e // 3 if e % 7 == 6 else e}" for e in events if e % 10 > 2}
    assert {t for t, status in out.items() if status != "error"} == {"t64", "t1234"}


def test_objects_that_never_change_are_resolved_once(spark, tmp_path):
    """Later batches look at new objects only, a failed one among them; first messages win."""
    folder, asked = str(tmp_path / "queue"), []
    known = lines_of(spark, [("k1", 0, "a", 1.0), ("k1", 1, "b", None), ("k2", 0, "a", 0.5)])

    def look(objects):
        asked.append(sorted(r.object_key for r in objects.collect()))
        if len(asked) == 2:
            raise ValueError("not now")
        return known(objects)

    for part, at in (([("t1", "k1"), ("t1", "k2")], 0), ([("t2", "k1"), ("t3", "k2"), ("t1", "k2")], 2), ([("t4", "k2"), ("t5", "k1")], 5)):
        queue.publish(messages(spark, part, at), folder, "k")
        drain(worker.start(queue.consume(spark, folder, 100), look, count, str(tmp_path / "out"), str(tmp_path / "progress"), fixed=True))
    assert asked == [["k1"], ["k2"], ["k2"]]  # the second failed, and was not kept
    got = {r.task_id: (r.object_key, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"t1": ("k1", "answered"), "t2": ("k1", "answered"), "t3": ("k2", "error"), "t4": ("k2", "answered"), "t5": ("k1", "answered")}


def test_tasks_asked_again_days_later_are_answered_once(spark, tmp_path):
    from lexbind.plans import stream_queries

    events = [100006, 100007, 290004, 290005, 300019, 300023]  # 300019 asks for the task of 100006
    spark.createDataFrame([(100006, "alpha beta")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(e,) for e in events], "event_id long").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    rows = stream_queries.QUERIES["worker_answers"](spark, str(tmp_path)).collect()
    assert sorted((r.task_id, r.event_id) for r in rows) == [(f"t{e}", e) for e in events if e != 300019]


def test_objects_are_read_once_for_all_looks(spark):
    """The engine looks at an object's lines several times; reading them runs once."""
    tasks = spark.createDataFrame([("t1", 0, "k1"), ("t2", 1, "k2")], "task_id string, seq long, object_key string")
    known, reads = lines_of(spark, [("k1", 0, "a", 1.0), ("k2", 0, "b", 1.0)]), spark.sparkContext.accumulator(0)

    def counted(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    def read(objects):
        rows = known(objects)
        return rows.mapInPandas(counted, rows.schema)

    got = worker.answers(tasks, read, count).collect()
    assert {r.task_id: r.status for r in got} == {"t1": "answered", "t2": "answered"} and reads.value == 2


def test_batch_without_new_objects_is_one_pass(spark, tmp_path, monkeypatch):
    """Tasks whose objects are known are answered without tables in between; beside a
    new object too, and the session's settings stay as they were."""
    folder, names, kept = str(tmp_path / "queue"), [], worker.stored
    known = lines_of(spark, [("k1", 0, "a", 1.0), ("k2", 0, "a", 0.5)])
    monkeypatch.setattr(worker, "stored", lambda df, name: names.append(name) or kept(df, name))
    settings = {k: spark.conf.get(k, None) for k in [*worker.STATE, "spark.sql.shuffle.partitions"]}
    for part, at, made in (([("t1", "k1"), ("t2", "k1")], 0, 3), ([("t3", "k1"), ("t1", "k1")], 2, 0), ([("t4", "k2"), ("t5", "k1")], 4, 3), ([("t6", "k2"), ("t5", "k2")], 6, 0)):
        names.clear()
        queue.publish(messages(spark, part, at), folder, "k")
        drain(worker.start(queue.consume(spark, folder, 100), known, count, str(tmp_path / "out"), str(tmp_path / "progress"), fixed=True))
        assert len(names) == made, names
        assert {k: spark.conf.get(k, None) for k in settings} == settings
    got = sorted((r.task_id, r.object_key, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(f"t{k}", "k2" if k in (4, 6) else "k1", "answered") for k in range(1, 7)]
    assert "RocksDB" in (tmp_path / "progress" / "offsets" / "0").read_text()
