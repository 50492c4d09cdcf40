"""Queries over the task stream, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.operators.matcher import CatalogIndex
from lexbind.operators.order import running
from lexbind.operators.store import shared_dir
from lexbind.plans.data import benchmark_catalog, printed_lines, table
from lexbind.streaming import queue, worker

#: Most messages of a micro-batch.
BATCH_MESSAGES = 20_000

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, and its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Task messages of the events; some malformed, some incomplete, some with extra members."""
    e = F.col("event_id")
    task = F.concat(F.lit('{"task_id":"t'), e.cast("string"), F.lit('","object_key":"'), (e % 1200).cast("string"), F.lit('"'))
    text = F.when(e % 10 == 0, F.lit("{broken")).when(e % 10 == 1, F.concat(F.lit('{"task_id":"t'), e.cast("string"), F.lit('"}'))).when(e % 10 == 2, F.concat(F.lit('{"task_id":5,"object_key":"'), e.cast("string"), F.lit('"}'))).when(e % 10 == 3, F.concat(task, F.lit(',"extra":1}'))).otherwise(F.concat(task, F.lit("}")))
    return table(spark, sf_dir, "events").select("event_id", text.alias("value"))


_VALID = "event_id % 10 > 2"


@query(f"""
SELECT event_id, CASE WHEN event_id % 10 IN (0, 2) THEN NULL ELSE 't' || event_id END AS task_id,
       CASE WHEN event_id % 10 IN (0, 1) THEN NULL WHEN event_id % 10 = 2 THEN CAST(event_id AS VARCHAR) ELSE CAST(event_id % 1200 AS VARCHAR) END AS object_key, {_VALID} AS valid FROM events
""")
def task_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return worker.parse_tasks(_messages(spark, sf_dir)).select("event_id", "task_id", "object_key", "valid")


@query(f"""
SELECT CASE WHEN NOT ({_VALID}) THEN 'drop' WHEN NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = event_id % 1200) THEN 'error' ELSE 'resolve' END AS route, count(*) AS n FROM events GROUP BY 1
""")
def task_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("object_key"))
    return worker.route(worker.parse_tasks(_messages(spark, sf_dir)), objects).groupBy("route").agg(F.count("*").alias("n"))


#: Repeats: every seventh event asks again for the task of an event far before it.
_TASK = "CASE WHEN event_id % 7 = 6 THEN event_id // 3 ELSE event_id END"


def _repeated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, at, value): task messages, some of tasks that were asked before, some malformed."""
    e = F.col("event_id")
    again = F.when(e % 7 == 6, F.floor(e / 3)).otherwise(e).cast("string")
    task = F.concat(F.lit('{"task_id":"t'), again, F.lit('","object_key":"'), (e % 1200).cast("string"), F.lit('"}'))
    text = F.when(e % 10 == 0, F.lit("{broken")).when(e % 10 == 1, F.concat(F.lit('{"task_id":"t'), again, F.lit('"}'))).when(e % 10 == 2, F.concat(F.lit('{"task_id":5,"object_key":"'), e.cast("string"), F.lit('"}'))).otherwise(task)
    return table(spark, sf_dir, "events").select("event_id", F.timestamp_seconds(e + 1_700_000_000).alias("at"), text.alias("value"))


def _queued(spark: SparkSession, sf_dir: str) -> tuple[str, int]:
    """A queue of the events' messages: (folder, messages of a micro-batch)."""
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    end = queue.publish(_repeated(spark, sf_dir), f"{root}/queue", "event_id")
    return root, max(1, min(BATCH_MESSAGES, -(-end // 3)))


def _span(spark: SparkSession, sf_dir: str) -> int:
    """Seconds from the first message to the last: tasks are asked again as late."""
    first, last = table(spark, sf_dir, "events").agg(F.min("event_id"), F.max("event_id")).first()
    return max(worker.KEEP, (last or 0) - (first or 0) + 1)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed_lines(spark, sf_dir).select(F.col("obs_id").cast("string").alias("object_key"), "line_idx", "text", (F.col("pct") / 100.0).alias("confidence"))


def _lines_of(lines: DataFrame):
    return lambda objects: objects.join(lines, "object_key").withColumnRenamed("object_key", "obs_id")


@query(f"""
WITH m AS (SELECT event_id, {_TASK} AS task, event_id % 1200 AS object FROM events WHERE {_VALID}),
first AS (SELECT task, min(event_id) AS event_id FROM m GROUP BY task),
lines AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN (doc_id * 31 + (i - 1) * 17) % 41 = 7 THEN 1 ELSE 0 END) AS bad
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE trim(line, ' ') <> '' GROUP BY doc_id)
SELECT 't' || task AS task_id, f.event_id AS event_id, CAST(f.event_id % 1200 AS VARCHAR) AS object_key,
       CASE WHEN n IS NULL OR bad > 0 THEN 'error' ELSE 'answered' END AS status, CASE WHEN n IS NULL OR bad > 0 THEN 0 ELSE n END AS n_lines
FROM first f LEFT JOIN lines ON doc_id = f.event_id % 1200
""")
def worker_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worker over all events with a resolver that counts lines: every task once,
    however often and in whatever batch it is asked again; objects with a line whose
    confidence is no number fail alone."""
    root, prefetch = _queued(spark, sf_dir)
    rows = printed_lines(spark, sf_dir)
    share = F.when(F.col("pct") == 67, F.lit(float("nan"))).otherwise(F.col("pct") / 100.0)
    lines = rows.select(F.col("obs_id").cast("string").alias("object_key"), "line_idx", "text", share.alias("confidence"))

    def count(observed: DataFrame) -> DataFrame:
        return observed.groupBy("obs_id").agg(F.lit("answered").alias("status"), F.count("*").cast("string").alias("result"))

    _drain(worker.start(queue.consume(spark, f"{root}/queue", prefetch), _lines_of(lines), count, f"{root}/out", f"{root}/progress", _span(spark, sf_dir), fixed=True))
    numbers = table(spark, sf_dir, "events").select("event_id")
    places = running(numbers, [], ["event_id"], seq=F.lit(1).cast("long"))
    out = spark.read.parquet(f"{root}/out").join(places, "seq")
    return out.select("task_id", "event_id", "object_key", "status", F.when(F.col("status") == "answered", F.col("result").cast("long")).otherwise(F.lit(0).cast("long")).alias("n_lines"))


@query("""
SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'no object_key' ELSE 'no task_id' END AS reason FROM events WHERE event_id % 10 <= 2
""")
def worker_dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of all events that are no task, with the reason."""
    root, prefetch = _queued(spark, sf_dir)
    _drain(worker.start_dead_letters(queue.consume(spark, f"{root}/queue", prefetch, "dead"), f"{root}/dead", f"{root}/progress-dead"))
    places = running(table(spark, sf_dir, "events").select("event_id"), [], ["event_id"], seq=F.lit(1).cast("long"))
    return spark.read.parquet(f"{root}/dead").join(places, "seq").select("event_id", "reason")


def _drain(run) -> None:
    """Let a stream take what there is, and stop it."""
    try:
        run.processAllAvailable()
    finally:
        run.stop()


@query()
def stream_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worker end to end on whole lines and whole items: (task_id, status, object_key)."""
    root, _ = _queued(spark, sf_dir)
    ix = CatalogIndex.build(benchmark_catalog(spark, sf_dir))
    _drain(worker.start(queue.consume(spark, f"{root}/queue", BATCH_MESSAGES), _lines_of(_lines(spark, sf_dir)), worker.resolver(ix), f"{root}/out", f"{root}/progress", _span(spark, sf_dir), fixed=True))
    return spark.read.parquet(f"{root}/out").select("task_id", "status", "object_key")
