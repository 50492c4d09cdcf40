"""Operator 9: WARC records in seekable Zstandard bundles.

A bundle is a sequence of independent Zstandard frames, each holding whole WARC
records up to about ``FRAME_BYTES``, followed by two skippable frames: a record
index (zstd-compressed JSON lines: record id, frame, offset in the frame's
decompressed bytes, length) and the seek table of the public seekable format
(for each frame: compressed and decompressed size; footer: number of frames,
descriptor, magic 0x8F92EAB1).  Any record is read by decompressing one frame.

Of records with equal payloads of at least ``REVISIT_BYTES`` bytes the one with
the smallest id is a ``response``; the others are ``revisit`` records without a
body that refer to it.

Bundles travel as a binary column of a table in the shared folder (see
:func:`write_bundles`), so retries and lost executors are covered by the
commit; :func:`export_bundles` writes plain files.

Edge cases: null html is an empty payload (a response); a null id is kept and
written as ``null`` (it sorts after all ids and refers as null); rows with equal
ids each get a record; null urls are empty; html of any length is kept whole (a
frame grows to fit); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind.llm.common import small_batches, stored, table

FRAME_BYTES = 256 * 1024
#: Raw bytes after which a task starts its next bundle.
BUNDLE_BYTES = 24 * 1024 * 1024
REVISIT_BYTES = 100
#: Parts that the rows of one payload are dealt to.
SALTS = 64
#: Time of capture of every record: the input has none, and results must not depend on the clock.
DATE = "1970-01-01T00:00:00Z"
SEEK_MAGIC = 0x8F92EAB1
SKIP_MAGIC = 0x184D2A5E
INDEX_MAGIC = 0x184D2A50


def record_bytes(page_id: int | None, url: str, kind: str, refers_to: int | None, digest: str, size: int, payload: bytes) -> bytes:
    """One WARC/1.1 record."""
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Date: {DATE}",
        f"WARC-Record-ID: <urn:page:{'null' if page_id is None else page_id}>",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; checks its length and, for a response, its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("record of a wrong length")
    payload = rest[:size]
    if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != "sha256:" + hashlib.sha256(payload).hexdigest():
        raise ValueError("payload and digest differ")
    return headers, payload


class BundleWriter:
    """Builds one bundle in memory."""

    def __init__(self, level: int = 3):
        import zstandard

        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._frames: list[bytes] = []
        self._sizes: list[tuple[int, int]] = []
        self._index: list[list] = []
        self._open = bytearray()
        self.raw = 0

    def add(self, record_id: str, record: bytes) -> None:
        if self._open and len(self._open) + len(record) > FRAME_BYTES:
            self._close()
        self._index.append([record_id, len(self._sizes), len(self._open), len(record)])
        self._open += record
        self.raw += len(record)

    def _close(self) -> None:
        packed = self._zstd.compress(bytes(self._open))
        self._frames.append(packed)
        self._sizes.append((len(packed), len(self._open)))
        self._open.clear()

    def finish(self) -> bytes:
        if self._open:
            self._close()
        index = self._zstd.compress("\n".join(json.dumps(x) for x in self._index).encode())
        index = struct.pack("<II", INDEX_MAGIC, len(index)) + index
        table = b"".join(struct.pack("<II", *s) for s in [*self._sizes, (len(index), 0)])
        table += struct.pack("<IBI", len(self._sizes) + 1, 0, SEEK_MAGIC)
        return b"".join(self._frames) + index + struct.pack("<II", SKIP_MAGIC, len(table)) + table


class BundleReader:
    """Random access to a bundle."""

    def __init__(self, data: bytes):
        import zstandard

        frames, _, magic = struct.unpack_from("<IBI", data, len(data) - 9)
        if magic != SEEK_MAGIC:
            raise ValueError("no seek table")
        self._data, self._zstd = memoryview(data), zstandard.ZstdDecompressor()
        at = len(data) - 9 - 8 * frames
        sizes = [struct.unpack_from("<II", data, at + 8 * k) for k in range(frames)]
        self._at = [0]
        for packed, _ in sizes:
            self._at.append(self._at[-1] + packed)
        index = self._data[self._at[-2] + 8 : self._at[-1]]
        self.index = [json.loads(x) for x in self._zstd.decompress(index).decode().split("\n") if x]
        self._held: tuple[int, bytes] = (-1, b"")

    def frame(self, k: int) -> bytes:
        if self._held[0] != k:
            self._held = (k, self._zstd.decompress(self._data[self._at[k] : self._at[k + 1]]))
        return self._held[1]

    def record(self, entry: list) -> bytes:
        _, frame, offset, size = entry
        return self.frame(frame)[offset : offset + size]

    def find(self, record_id: str) -> list[bytes]:
        """The records with an id."""
        return [self.record(x) for x in self.index if x[0] == record_id]


def with_originals(pages: DataFrame) -> DataFrame:
    """Add payload_bytes, payload_digest, record_type, refers_to.

    Only (digest, salt) pairs are grouped: partial minima by salt, then the
    minimum over at most SALTS rows of a digest, joined back on digest and
    salt, so that a payload with a third of all rows is spread over SALTS keys.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("html").cast("long"), "payload_digest": F.sha2(F.col("html").cast("binary"), 256)})
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
    parts = rows.where(F.col("payload_bytes") >= REVISIT_BYTES).groupBy("payload_digest", "_salt").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n"))
    every = Window.partitionBy("payload_digest")
    parts = parts.withColumns({"_first": F.min("_first").over(every), "_n": F.sum("_n").over(every)})
    parts = parts.where("_n > 1 and _first is not null").drop("_n")
    out = rows.join(parts, ["payload_digest", "_salt"], "left")
    # Of rows that share the smallest id too, each is a response.
    again = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return out.select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("_first")).alias("refers_to"),
    )


def write_bundles(records: DataFrame, name: str = "warc") -> DataFrame:
    """Write the rows of :func:`with_originals` as bundles; returns the written table (bundle, image)."""

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def flush():
            return pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{seq:04d}"]), pa.array([writer.finish()], pa.binary())], ["bundle", "image"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for r in batch.slice(lo, 64).to_pylist():
                    payload = b"" if r["record_type"] == "revisit" else r["html"].encode()
                    key = "null" if r["page_id"] is None else str(r["page_id"])
                    writer.add(key, record_bytes(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_digest"], r["payload_bytes"], payload))
                    if writer.raw >= BUNDLE_BYTES:
                        yield flush()
                        seq, writer = seq + 1, BundleWriter()
        if writer.raw:
            yield flush()

    small_batches(records.sparkSession)
    return stored(records.mapInArrow(bundles, "bundle string, image binary"), name)


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record of written bundles, parsed and checked, with its place."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, image in zip(batch.column(0).to_pylist(), batch.column(1)):
                reader = BundleReader(image.as_py())
                out: list[list] = [[] for _ in range(9)]
                for entry in reader.index:
                    headers, payload = parse_record(reader.record(entry))
                    key = headers["WARC-Record-ID"][len("<urn:page:") : -1]
                    refers = headers.get("WARC-Refers-To")
                    values = (
                        None if key == "null" else int(key),
                        int(headers["X-Payload-Length"]),
                        headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                        headers["WARC-Type"],
                        None if refers is None else int(refers[len("<urn:page:") : -1]),
                        headers["WARC-Target-URI"],
                        name,
                        entry[1],
                        entry[2],
                    )
                    for column, value in zip(out, values):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "bundle", "frame", "frame_offset"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, bundle string, frame int, frame_offset long"
    return bundles.mapInArrow(rows, schema)


def export_bundles(bundles: DataFrame, folder: str) -> list[str]:
    """Write the bundles to a folder the driver can reach, one at a time."""
    out = []
    for row in bundles.orderBy("bundle").toLocalIterator():
        out.append(f"{folder}/bundle-{row.bundle}.warc.zst")
        with open(out[-1], "wb") as f:
            f.write(row.image)
    return out


def op9_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write a record for each ``pages`` row and read the bundles back."""
    return read_bundles(write_bundles(with_originals(table(spark, sf_dir, "pages")))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_SQL = {
    "op9_seekable_warc": """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
}
