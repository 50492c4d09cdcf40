"""Writers: all go through Spark's committer, so a result appears whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str, overwrite: bool = False, order: str | None = None) -> None:
    """JSON lines; refuses an existing target unless told to replace it."""
    out = df.orderBy(order).drop(order) if order else df
    out.write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", False).json(path)


def write_merged(df: DataFrame, source: str, path: str, overwrite: bool = False) -> None:
    """Like :func:`write_json`, but never onto its own input."""
    if source.rstrip("/") == path.rstrip("/"):
        raise ValueError("output equals input")
    write_json(df, path, overwrite)


def write_phrases(df: DataFrame, path: str, column: str = "phrase", overwrite: bool = False) -> int:
    """Distinct phrases by (case-folded, exact) order; returns their number."""
    rows = df.select(column).where(f"{column} is not null").distinct()
    rows.orderBy(F.lower(column), column).coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(path)
    return rows.count()


def write_manifest(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Tab-separated label manifest with a header."""
    df.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("sep", "\t").csv(path)


def write_report(df: DataFrame, ratios: list[str], path: str, overwrite: bool = False) -> None:
    """A report as CSV, with ratios to four places, and as JSON lines, as they are:
    the folders ``csv`` and ``json`` of a path."""
    mode = "overwrite" if overwrite else "errorifexists"
    lists = [f.name for f in df.schema if f.dataType.simpleString().startswith("array")]
    out = df.withColumns({c: F.format_string("%.4f", F.col(c)) for c in ratios} | {c: F.array_join(c, " ") for c in lists})
    out.write.mode(mode).option("header", True).csv(f"{path}/csv")
    df.write.mode(mode).option("ignoreNullFields", False).json(f"{path}/json")


def run_summary(counts: dict[str, DataFrame], **settings) -> str:
    """JSON summary of small aggregate tables and the run's settings."""
    return json.dumps(settings | {k: [r.asDict(True) for r in df.collect()] for k, df in counts.items()}, ensure_ascii=False, indent=2, default=str)
