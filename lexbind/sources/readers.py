"""Readers with the checks that the inputs need."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind import schemas
from lexbind.operators.catalog import WRAPPERS, ConstraintError, catalog_problems, first_of, require_none
from lexbind.operators.order import running

BAD = "_corrupt_record"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines catalog: blank lines skipped, a leading BOM ignored, bad
    JSON, wrong versions, missing and repeated ids, or no row at all fail."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^﻿", "")).where(F.trim("value") != "")
    rows = lines.select("value", F.from_json("value", f"{schemas.CATALOG}, {BAD} string", {"columnNameOfCorruptRecord": BAD}).alias("r"))
    bad = rows.where(f"r.{BAD} is not null")
    if not bad.isEmpty():
        require_none(_numbered(spark, path).join(bad.select("value").distinct(), "value", "left_semi").select("row", F.substring("value", 1, 80).alias("line")).orderBy("row"), "bad JSON")
    catalog = rows.select("r.*").drop(BAD)
    if catalog.isEmpty():
        raise ConstraintError("the catalog is empty")
    require_none(catalog_problems(catalog), "catalog")
    return catalog


def _numbered(spark: SparkSession, path: str) -> DataFrame:
    """(row, value): the lines of a file with their 1-based numbers, blank ones counted."""
    lines = spark.read.text(path).withColumn("value", F.regexp_replace("value", "^\ufeff", "")).withColumn("_id", F.monotonically_increasing_id())
    return running(lines, [], ["_id"], row=F.lit(1).cast("long")).select((F.col("row") + 1).alias("row"), "value")


def read_objects(spark: SparkSession, path: str, wrappers: tuple[str, ...] = WRAPPERS) -> DataFrame:
    """(pos, raw VARIANT): the objects of a JSON list, or of the first
    list under one of ``wrappers``; anything that is no object is dropped."""
    whole = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    rows = whole.select(F.posexplode(first_of(F.parse_json("value"), wrappers)).alias("pos", "raw"))
    return rows.where(F.schema_of_variant("raw").startswith("OBJECT"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, raw VARIANT) of a JSON list of objects; anything else fails."""
    whole = spark.read.text(path, wholetext=True).withColumn("value", F.regexp_replace("value", "^﻿", ""))
    require_none(whole.where(~F.schema_of_variant(F.parse_json("value")).startswith("ARRAY")).select(F.lit(path).alias("path")), "not a list")
    rows = whole.select(F.posexplode(F.try_variant_get(F.parse_json("value"), "$", "array<variant>")).alias("pos", "raw"))
    require_none(rows.where(~F.schema_of_variant("raw").startswith("OBJECT")).select("pos"), "not an object")
    return rows


def read_table(spark: SparkSession, path: str, required: list[str], sep: str = ",", names: list[str] | None = None) -> DataFrame:
    """A CSV or TSV file with its required header; cells trimmed, null to empty.
    ``names`` renames the required columns, in order."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    columns = {c.lstrip("﻿").strip(): c for c in df.columns}
    missing = [c for c in required if c not in columns]
    if missing:
        raise ConstraintError(f"missing columns: {missing}")
    return df.select(*[F.coalesce(F.trim(F.col(f"`{columns[c]}`")), F.lit("")).alias(n) for c, n in zip(required, names or required)])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """(filename, label, pool) of a label manifest."""
    return read_table(spark, path, ["filename", "label", "pool"], "\t")


def labels_from_names(files: DataFrame) -> DataFrame:
    """(filename, label, pool) from names like ``Some text_latin-0001.png``: the
    label stands before the last underscore, the pool after it and before a dash;
    names without an underscore are left out."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    tail = F.regexp_extract(stem, r"_([^_]*)$", 1)
    pool = F.when(F.instr(tail, "-") > 0, F.element_at(F.split(tail, "-"), 1)).otherwise(F.lit("unknown"))
    return files.where(F.instr(stem, "_") > 0).select("filename", F.regexp_replace(stem, r"_[^_]*$", "").alias("label"), pool.alias("pool"))


def read_labels(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(filename, label, pool) of a sample folder: its ``labels.tsv``, or else the
    names of its files."""
    names = list_files(spark, folder, (*suffixes, "labels.tsv")).select(F.element_at(F.split("path", "/"), -1).alias("filename"))
    if names.where("filename = 'labels.tsv'").isEmpty():
        return labels_from_names(names)
    return read_manifest(spark, f"{folder.rstrip('/')}/labels.tsv")


def read_phrases(spark: SparkSession, path: str, least: int = 2, most: int = 32) -> DataFrame:
    """(pos, phrase) of a phrase file: cleaned, of the right length, first of
    equal ones; an empty result fails."""
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("pos", "line"))
    t = F.regexp_replace("line", r'[\\/:*?"<>|]', " ")
    t = F.regexp_replace(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")), r"^[ .]+|[ .]+$", "")
    rows = rows.select("pos", t.alias("phrase")).where(F.length("phrase").between(least, most))
    rows = rows.groupBy("phrase").agg(F.min("pos").alias("pos")).select("pos", "phrase")
    if rows.isEmpty():
        raise ConstraintError(f"no phrase in {path}")
    return rows


def list_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """(path, length) of a folder's files by suffix, ignoring case, in order."""
    rows = spark.read.format("binaryFile").load(folder).select("path", "length")
    return rows.where(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$")).orderBy("path")


def first_paths(explicit: DataFrame, found: DataFrame) -> DataFrame:
    """Explicit paths, then found ones; of equal paths the first stays."""
    rows = explicit.select("path", F.lit(0).alias("part"), F.col("pos")).union(found.select("path", F.lit(1), F.lit(0)))
    w = Window.partitionBy("path").orderBy("part", "pos")
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("path", "part", "pos")


def audited_files(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """:func:`list_files`; a folder without any such file fails."""
    rows = list_files(spark, folder, suffixes)
    if rows.isEmpty():
        raise ConstraintError(f"no file of {', '.join(suffixes)} in {folder}")
    return rows


def image_paths(spark: SparkSession, explicit: list[str], folder: str | None = None, default: str | None = None, suffixes: tuple[str, ...] = (".jpg", ".jpeg", ".png")) -> DataFrame:
    """(path, part, pos): the explicit paths, then a folder's images in order, each
    path once; the default file if that is none."""
    files = spark.createDataFrame([(p, k) for k, p in enumerate(explicit)], "path string, pos int")
    found = list_files(spark, folder, suffixes) if folder else spark.createDataFrame([], "path string, length long")
    rows = first_paths(files, found)
    if default is not None and rows.isEmpty():
        return spark.createDataFrame([(default, 0, 0)], "path string, part int, pos int")
    return rows


def fetch_objects(spark: SparkSession, tasks: DataFrame, root: str) -> DataFrame:
    """Tasks (a micro-batch of them) with the content of their object under a root
    folder or bucket URL; null where there is none.

    Each key is opened by the executor that holds it, once however many tasks name
    it; nothing is listed and no path passes the driver.  Keys lead into the root
    only.
    """
    root = root.rstrip("/")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:"))
        for batch in batches:
            for key in batch.column(0).to_pylist():
                content = None
                if key and ".." not in key.split("/"):
                    path = f"{base}/{key}"
                    if files.get_file_info(path).type == fs.FileType.File:
                        with files.open_input_stream(path) as f:
                            content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([content], pa.binary())], ["object_key", "content"])

    keys = tasks.select("object_key").where("object_key is not null").distinct()
    return tasks.join(keys.mapInArrow(read, "object_key string, content binary"), "object_key", "left").select(*tasks.columns, "content")
