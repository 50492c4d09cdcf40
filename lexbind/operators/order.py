"""Positions and running sums over rows in order, spread over tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind.operators.store import stored


def running(df: DataFrame, by: list[str], order: list[str], **values: Column) -> DataFrame:
    """``df`` with, for each named value, its sum over the rows before in
    ``order`` within ``by``; ``F.lit(1)`` gives positions from 0.

    Rows are dealt by ranges of (by, order) and stored, summed up inside each
    part, and moved on by the totals of the parts before: a group of any size is
    never in one task, and what meets is a row for each part and group.
    """
    held = df.withColumns({f"_v_{k}": v for k, v in values.items()})
    parts = stored(held.repartitionByRange(*[F.col(c) for c in [*by, *order]]).withColumn("_part", F.spark_partition_id()), "ordered")
    inside = Window.partitionBy("_part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = parts.withColumns({f"_in_{k}": F.coalesce(F.sum(f"_v_{k}").over(inside), F.lit(0)) for k in values})
    totals = parts.groupBy("_part", *by).agg(*[F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values])
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_part", *[F.col(c).alias(f"_by_{c}") for c in by], *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_off_{k}") for k in values])
    same = rows["_part"] == totals["_part"]
    for c in by:
        same = same & rows[c].eqNullSafe(totals[f"_by_{c}"])
    joined = rows.join(totals, same)
    return joined.select(*df.columns, *[(F.col(f"_in_{k}") + F.col(f"_off_{k}")).alias(k) for k in values])
