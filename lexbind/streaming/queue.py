"""A durable task queue in a shared folder, and a streaming source that consumes it.

Publishing numbers the messages and writes them in segments; an entry in ``heads``,
written last, makes them visible.  Consuming hands out at most ``prefetch`` messages a
micro-batch, one partition a segment, read by the executors from the segment's own
folder.  What was handed out and what was acknowledged (when Spark commits a batch) is
noted for each consumer, so that a restarted query goes on where its checkpoint is.
Any file system that Arrow opens serves; one publisher writes at a time.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from lexbind.operators.order import running

#: Messages of a segment, and of a micro-batch.
SEGMENT, PREFETCH = 5_000, 20_000
SCHEMA = "seq long, at timestamp, value string"
FORMAT = "lexbind_queue"


def _open(folder: str):
    """(Arrow file system, path) of a folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))


def _names(folder: str) -> list[str]:
    from pyarrow import fs

    files, path = _open(folder)
    return sorted(f.base_name for f in files.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def _note(folder: str, name: str) -> None:
    files, path = _open(folder)
    files.create_dir(path, recursive=True)
    files.open_output_stream(f"{path}/{name}").close()


def heads(folder: str) -> list[tuple[int, int, int, str]]:
    """(first, end, messages of a segment, run) of every published range, in order."""
    return [(int(first), int(end), int(size), run) for end, first, size, run in (n.split("-", 3) for n in _names(f"{folder}/heads"))]


def publish(messages: DataFrame, folder: str, order: str) -> int:
    """Append messages (``value``, ``at``, in order of a column) to a queue;
    returns the number of the next one."""
    first = max((end for _, end, *_ in heads(folder)), default=0)
    run = uuid.uuid4().hex
    rows = running(messages.select("value", "at", order), [], [order], seq=F.lit(1).cast("long")).withColumn("seq", F.col("seq") + first)
    rows = rows.select("seq", "at", "value", F.floor(F.col("seq") / SEGMENT).alias("segment"))
    rows.repartition("segment").sortWithinPartitions("segment", "seq").write.partitionBy("segment").parquet(f"{folder}/log/{run}")
    end = first + messages.sparkSession.read.schema("seq long").parquet(f"{folder}/log/{run}").count()
    if end > first:
        _note(f"{folder}/heads", f"{end:020d}-{first:020d}-{SEGMENT}-{run}")
    return end


class Segment(InputPartition):
    """Messages lo to hi of one segment of one published range."""

    def __init__(self, path: str, lo: int, hi: int):
        self.path, self.lo, self.hi = path, lo, hi


class QueueReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.folder = options["path"].rstrip("/")
        self.prefetch = int(options.get("prefetch", PREFETCH))
        self.consumer = options.get("consumer", "default")
        self.sent = self._noted("sent")

    def _noted(self, kind: str) -> int:
        return max((int(n) for n in _names(f"{self.folder}/{kind}/{self.consumer}")), default=0)

    def initialOffset(self) -> dict:
        self.sent = 0  # a query without a checkpoint starts over
        return {"seq": 0}

    def latestOffset(self) -> dict:
        end = max((end for _, end, *_ in heads(self.folder)), default=0)
        return {"seq": max(self.sent, min(end, self.sent + self.prefetch))}

    def partitions(self, start: dict, end: dict) -> list[Segment]:
        lo, hi = start["seq"], end["seq"]
        if hi > self.sent:
            self.sent = hi
            _note(f"{self.folder}/sent/{self.consumer}", str(hi))
        out = []
        for first, stop, size, run in heads(self.folder):
            a, b = max(first, lo), min(stop, hi)
            for s in range(a // size, -(-b // size) if b > a else a // size):
                out.append(Segment(f"{self.folder}/log/{run}/segment={s}", max(a, s * size), min(b, (s + 1) * size)))
        return out

    def read(self, partition: Segment) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyarrow import parquet

        files, path = _open(partition.path)
        schema = pa.schema([("seq", pa.int64()), ("at", pa.timestamp("us", tz="UTC")), ("value", pa.string())])
        for name in _names(partition.path):
            if name.endswith(".parquet"):
                rows = parquet.ParquetFile(files.open_input_file(f"{path}/{name}")).read(["seq", "at", "value"]).cast(schema)
                seq = rows.column("seq")
                yield from rows.filter(pc.and_(pc.greater_equal(seq, partition.lo), pc.less(seq, partition.hi))).to_batches()

    def commit(self, end: dict) -> None:
        _note(f"{self.folder}/acknowledged/{self.consumer}", str(end["seq"]))


class QueueSource(DataSource):
    """``spark.readStream.format("lexbind_queue").load(folder)`` with the options
    ``prefetch`` and ``consumer``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> QueueReader:
        return QueueReader(dict(self.options))


def consume(spark: SparkSession, folder: str, prefetch: int = PREFETCH, consumer: str = "default") -> DataFrame:
    """The messages of a queue as a stream (seq, at, value)."""
    spark.dataSource.register(QueueSource)
    return spark.readStream.format(FORMAT).option("prefetch", prefetch).option("consumer", consumer).load(folder)


def acknowledged(folder: str, consumer: str = "default") -> int:
    """Messages that a consumer has acknowledged."""
    return max((int(n) for n in _names(f"{folder}/acknowledged/{consumer}")), default=0)
