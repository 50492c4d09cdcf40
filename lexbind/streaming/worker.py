"""Task worker on Structured Streaming: every task is answered once.

Messages (seq, at, value: JSON with task_id and object_key) come from a stream, such as
:func:`lexbind.streaming.queue.consume`.

* Messages that are no task go to the dead letters with a reason; they get no answer.
* A task_id is remembered in keyed state for ``KEEP`` after its first message; of its
  messages in a micro-batch the first counts, those of later batches are ignored.
* A micro-batch resolves each object once, however many tasks ask for it.  Where objects
  never change (``fixed``), a result serves the tasks of later batches too.  A task
  whose object cannot be read, or whose lines break the input contract, gets an error
  answer alone.  Should a batch fail as a whole, it is halved by object until the
  object that fails stands alone.
* A batch's answers are written to a folder of its own, which a repeated attempt
  replaces: together with the state, each task has exactly one answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexbind.operators import lines
from lexbind.operators.matcher import CatalogIndex, resolve
from lexbind.operators.store import stored

#: How long a task_id is remembered, in seconds of ``at``; messages may come as late.
KEEP = 86_400
#: Error answers (fixed values).
FAILED = "recognition_failed"
RESULT = ("status", "ocr_lines", "best_match", "alternatives", "candidates", "score_type", "rejection_reason")
SCORE_TYPE = "uncalibrated_catalog_match_score"


def parse_tasks(messages: DataFrame, column: str = "value") -> DataFrame:
    """(value, task_id, object_key, valid): both members must be strings; extra
    members do not matter."""
    v = F.try_parse_json(column)

    def member(name: str):
        m = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(m) == "STRING", F.try_variant_get(v, f"$.{name}", "string"))

    rows = messages.withColumns({"task_id": member("task_id"), "object_key": member("object_key")})
    return rows.withColumn("valid", F.col("task_id").isNotNull() & F.col("object_key").isNotNull())


def dead_letters(messages: DataFrame) -> DataFrame:
    """Messages that are no task, with the ``reason``."""
    reason = F.when(F.try_parse_json("value").isNull(), "not JSON").when(F.col("task_id").isNull(), "no task_id").otherwise("no object_key")
    return parse_tasks(messages).where("not valid").select("seq", "at", "value", reason.alias("reason"))


def route(tasks: DataFrame, objects: DataFrame) -> DataFrame:
    """Tasks with ``route``: drop (malformed), error (no such object) or resolve."""
    known = objects.select("object_key").distinct().withColumn("_has", F.lit(True))
    rows = tasks.join(known, "object_key", "left")
    return rows.withColumn("route", F.when(~F.col("valid"), "drop").when(F.col("_has").isNull(), "error").otherwise("resolve")).drop("_has")


def _first_of_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each task_id in a part of a micro-batch, the message with the least number."""
    held = list(batches)
    if held:
        rows = pa.Table.from_batches(held).sort_by("seq")
        at = pa.array(range(rows.num_rows), pa.int64())
        firsts = rows.append_column("_at", at).group_by("task_id").aggregate([("_at", "min")])
        yield from rows.take(firsts.column("_at_min").combine_chunks()).to_batches()


def first_messages(tasks: DataFrame, keep: int = KEEP) -> DataFrame:
    """(task_id, seq, object_key): the first message of each task_id of a stream of
    valid tasks (seq, at, task_id, object_key); a task is known for at least ``keep``
    seconds of ``at`` after that message, and messages may come as late.

    Each part of a micro-batch keeps the first message of its tasks; Spark's own
    deduplication drops tasks of earlier batches.
    """
    rows = tasks.select("seq", "at", "task_id", "object_key")
    firsts = rows.repartition("task_id").mapInArrow(_first_of_part, rows.schema)
    return firsts.withWatermark("at", f"{keep} seconds").dropDuplicatesWithinWatermark(["task_id"]).select("task_id", "seq", "object_key")


def enriched(decided: DataFrame, catalog: DataFrame) -> DataFrame:
    """Decisions whose best match, alternatives and candidates are catalog rows with
    the candidate's other members: where both have one, the catalog's value wins.
    A candidate that the catalog lacks stays as it is, other members null."""
    lists = ("candidates", "alternatives", "best_match")
    ids = F.array_compact(F.flatten(F.array(F.transform("candidates", lambda c: c["id"]), F.array("best_match.id"))))
    asked = decided.select("obs_id", F.explode(F.array_distinct(ids)).alias("id"))
    columns = catalog.columns
    known = asked.join(catalog, "id").groupBy("obs_id").agg(F.map_from_entries(F.collect_list(F.struct("id", F.struct(*columns).alias("product")))).alias("_products"))
    rows = decided.join(known, "obs_id", "left")
    types = {f.name: f.dataType for f in catalog.schema}
    members = {f: (decided.schema[f].dataType if f == "best_match" else decided.schema[f].dataType.elementType).names for f in lists}

    def wider(f: str) -> Callable[[Column], Column]:
        def of(c: Column) -> Column:
            product = F.try_element_at("_products", c["id"])
            own = {m: c[m] for m in members[f]}
            merged = [F.when(product.isNotNull(), product[m]).otherwise(own[m].cast(types[m]) if m in own else F.lit(None)).alias(m) for m in columns]
            return F.struct(*merged, *[v.alias(m) for m, v in own.items() if m not in columns])

        return of

    return rows.withColumns({f: F.when(F.col(f).isNotNull(), wider(f)(F.col(f))) if f == "best_match" else F.transform(f, wider(f)) for f in lists}).drop("_products")


def resolver(ix: CatalogIndex, top_k: int = 5) -> Callable[[DataFrame], DataFrame]:
    """The engine as a worker's resolver: lines to (obs_id, status, result as JSON)."""

    def run(observed: DataFrame) -> DataFrame:
        rows = enriched(resolve(observed, ix, top_k), ix.catalog)
        return rows.select("obs_id", "status", F.to_json(F.struct(*RESULT)).alias("result"))

    return run


def _error(error: str) -> Column:
    none = F.array().cast("array<string>")
    members = {"status": F.lit("error"), "ocr_lines": none, "alternatives": none, "candidates": none, "score_type": F.lit(SCORE_TYPE), "error": F.lit(error)}
    return F.to_json(F.struct(*[c.alias(k) for k, c in members.items()]))


def answers(tasks: DataFrame, lines_of: Callable[[DataFrame], DataFrame], resolve_lines: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(task_id, seq, object_key, status, result) of tasks with distinct ids.

    ``lines_of`` maps objects (object_key) to observed lines (obs_id = object_key);
    ``resolve_lines`` maps lines to (obs_id, status, result).
    """
    objects = tasks.select("object_key").distinct()
    observed = stored(lines_of(objects), "observed")  # objects are read once, however often the engine looks at their lines
    bad = lines.invalid_lines(observed).select("obs_id").distinct()
    decided = resolve_lines(observed.join(bad, "obs_id", "left_anti")).withColumnRenamed("obs_id", "object_key")
    rows = tasks.join(decided.select("object_key", "status", "result"), "object_key", "left")
    lost = F.col("status").isNull()
    return rows.select("task_id", "seq", "object_key", F.when(lost, "error").otherwise(F.col("status")).alias("status"), F.when(lost, _error(FAILED)).otherwise(F.col("result")).alias("result"))


def isolated(tasks: DataFrame, answer: Callable[[DataFrame], DataFrame], round_: int = 0) -> list[DataFrame]:
    """Answers of a stored table of tasks, stored: where they fail as a whole, halves
    by object are tried, until an object that fails stands alone (``failed``)."""
    try:
        return [stored(answer(tasks).withColumn("failed", F.lit(False)), "answers")]
    except Exception:
        if tasks.select("object_key").distinct().limit(2).count() < 2:
            return [stored(tasks.select("task_id", "seq", "object_key", F.lit("error").alias("status"), _error(FAILED).alias("result"), F.lit(True).alias("failed")), "answers")]
    out = []
    for half in (0, 1):
        part = stored(tasks.where(F.pmod(F.xxhash64("object_key", F.lit(round_)), F.lit(2)) == half), "tasks")
        if not part.isEmpty():
            out += isolated(part, answer, round_ + 1)
    return out


#: Results that are kept for later batches.
KEPT = "object_key string, status string, result string, batch_id int"
#: State stays on the executors' disks, with logs of changes: a batch costs what it
#: changes, not what is remembered.  Parts of the state for each core.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
STATE_PARTS_A_CORE = 1


def _results(spark: SparkSession, folder: str, before: int) -> DataFrame | None:
    """(object_key, status, result) that batches before a batch have kept."""
    try:
        rows = spark.read.schema(KEPT).parquet(folder).where(F.col("batch_id") < before).drop("batch_id")
    except AnalysisException:  # nothing is kept so far
        return None
    return rows


@contextmanager
def _state_conf(spark: SparkSession) -> Iterator[None]:
    """Settings of the state for a stream that is started inside; a stream that goes on
    takes those of its checkpoint."""
    conf = STATE | {"spark.sql.shuffle.partitions": str(spark.sparkContext.defaultParallelism * STATE_PARTS_A_CORE)}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def start(messages: DataFrame, lines_of: Callable[[DataFrame], DataFrame], resolve_lines: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str, keep: int = KEEP, fixed: bool = False) -> StreamingQuery:
    """Answer every task of a stream of messages once, into ``folder``.

    ``fixed``: objects never change, so that their results are kept beside ``folder``
    and later batches look at objects that are new to them only; failures are not kept.
    A batch without new objects is one job: its answers go where they stay.
    """
    tasks = first_messages(parse_tasks(messages).where("valid"), keep)
    members = ("task_id", "seq", "object_key", "status", "result")
    held: list[DataFrame] = []  # results of former batches, while no new ones come

    def batch(rows: DataFrame, batch_id: int) -> None:
        if fixed and not held:
            known = _results(rows.sparkSession, f"{folder}_results", batch_id)
            held.extend([] if known is None else [known])
        if not held:
            fresh = stored(rows, "tasks")
            if not fresh.isEmpty():
                _answer(fresh, batch_id, "overwrite")
            return
        rows = rows.persist()
        try:
            seen = Observation()
            told = rows.join(held[0], "object_key", "left").observe(seen, F.count(F.when(F.col("status").isNull(), 1)).alias("fresh"))
            told.where("status is not null").select(*members).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")
            if seen.get["fresh"]:
                _answer(stored(rows.join(held[0], "object_key", "left_anti"), "fresh"), batch_id, "append")
        finally:
            rows.unpersist()

    def _answer(fresh: DataFrame, batch_id: int, mode: str) -> None:
        """Answers of tasks whose objects are new, beside those of the batch that are there."""
        made = reduce(DataFrame.union, isolated(fresh, lambda t: answers(t, lines_of, resolve_lines)))
        if fixed:
            made.where("not failed").dropDuplicates(["object_key"]).select("object_key", "status", "result").write.mode("overwrite").parquet(f"{folder}_results/batch_id={batch_id}")
            held.clear()
        made.select(*members).write.mode(mode).parquet(f"{folder}/batch_id={batch_id}")

    with _state_conf(messages.sparkSession):
        return tasks.writeStream.outputMode("append").foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def start_dead_letters(messages: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keep every message of a stream that is no task, once, in ``folder``."""
    return dead_letters(messages).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).start()


__all__ = ["answers", "dead_letters", "enriched", "first_messages", "isolated", "parse_tasks", "resolver", "route", "start", "start_dead_letters"]
