"""Recogniser readings: reliability, consensus of passes, duplicates.

The recogniser itself is a plug-in: a function from batches of crops to
(text, char_conf) rows, applied with :func:`recognize`.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from lexbind.functions import text as T
from lexbind.functions.similarity import key_similarity

#: Least mean, minimum and lower quartile of a reading's confidences.
MEAN, LEAST, QUARTILE = 0.88, 0.55, 0.75
#: Crop margins of one and of three passes.
MARGINS = {1: (0.04,), 3: (0.0, 0.04, 0.08)}


def recognize(crops: DataFrame, recognizer: Callable, schema: str) -> DataFrame:
    """Apply a recogniser (an iterator of Arrow batches to an iterator of them)."""
    return crops.mapInArrow(recognizer, schema)


def with_margins(crops: DataFrame, passes: int) -> DataFrame:
    """Each crop once for each pass, with its margin."""
    margins = F.array(*[F.struct(F.lit(k).alias("pass_index"), F.lit(m).alias("margin")) for k, m in enumerate(MARGINS[passes])])
    return crops.select("*", F.explode(margins).alias("_m")).select(*crops.columns, "_m.pass_index", "_m.margin")


def quantile(values: Column, q: float, ordered: bool = False) -> Column:
    """Linearly interpolated quantile of an array (``ordered`` or not); null if empty."""
    ranked = values if ordered else F.sort_array(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(ranked, low + 1), F.try_element_at(ranked, F.least(low + 2, F.size(values)))
    return F.when(F.size(values) > 0, a + (b - a) * (at - low))


def _confidence(values: pa.Array, first: pa.Array, plausible: pa.Array) -> pa.Array:
    """Mean (summed from the left), least, lower quartile and sum in whole percents of
    the first so many values of each array, null for none or where one is missing;
    how many there are; and whether these and the text (``plausible``) are good enough."""
    offsets = values.offsets.to_numpy().astype(np.int64)
    starts, ends = offsets[:-1], offsets[1:]
    known = pc.and_(pc.is_valid(values), pc.is_valid(first)).to_numpy(zero_copy_only=False)
    ends = np.where(known, np.minimum(ends, starts + np.maximum(first.fill_null(0).to_numpy(), 0)), starts)
    flat = values.values
    lost = np.concatenate([[0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))])
    flat = flat.fill_null(0.0).to_numpy()
    good = (ends > starts) & (lost[ends] == lost[starts])
    out = np.zeros((3, len(starts)))
    percent = np.zeros(len(starts), np.int64)
    hundredths = flat * 100
    hundredths = np.copysign(np.floor(np.abs(hundredths) + 0.5), hundredths)
    for row in np.flatnonzero(good).tolist():
        held = flat[starts[row] : ends[row]]
        n = len(held)
        at = (n - 1) * 0.25
        low = int(at)
        ranked = np.partition(held, (0, low, min(low + 1, n - 1)))
        a, b = ranked[low], ranked[min(low + 1, n - 1)]
        out[:, row] = np.add.accumulate(held)[-1] / n, ranked[0], a + (b - a) * (at - low)
        whole = hundredths[starts[row] : ends[row]].sum()
        percent[row] = whole if np.isfinite(whole) else 0
    fields = [*(pa.array(c, pa.float64(), mask=~good) for c in out), pa.array(percent, pa.int64(), mask=~good)]
    good &= plausible.fill_null(False).to_numpy(zero_copy_only=False) & (out[0] >= MEAN) & (out[1] >= LEAST) & (out[2] >= QUARTILE)
    return pa.StructArray.from_arrays([*fields, pa.array(ends - starts, pa.int32()), pa.array(good)], ["mean", "least", "quartile", "percent", "n", "accepted"])


#: Marked so that Spark does not work it out again for each filter on its members.
confidence = F.arrow_udf(_confidence, StructType([*(StructField(c, DoubleType()) for c in ("mean", "least", "quartile")), StructField("percent", LongType()), StructField("n", IntegerType()), StructField("accepted", BooleanType())])).asNondeterministic()


def gated(readings: DataFrame, multilingual: bool = True) -> DataFrame:
    """Readings with collapsed text, mean, least and quartile confidence of the
    visible characters, their sum in whole percents, and ``accepted``."""
    rows = readings.withColumn("text", T.collapse_repeats("text"))
    # Spaces are the only white space of a collapsed text.
    visible = F.length(F.replace("text", F.lit(" "), F.lit("")))
    rows = rows.withColumn("_s", confidence("char_conf", visible, T.plausible("text", multilingual)))
    return rows.select(*readings.columns, *[F.col(f"_s.{c}").alias(c) for c in ("mean", "least", "quartile", "percent", "accepted")])


def consensus(readings: DataFrame) -> DataFrame:
    """(obs_id, crop_index, text, mean, accepted): the pass to believe.

    Of accepted passes: the best mean of the largest group of equal texts, if it
    has two; else confidence plus agreement minus a small cost of length.  With
    none accepted, the reading of the greatest mean, not accepted.

    The passes of a crop meet once; texts are compared only where no two are equal.
    """
    reading = F.struct("pass_index", "text", "mean", "accepted", T.duplicate_key("text").alias("dup"))
    rows = readings.select("obs_id", "crop_index", reading.alias("r")).groupBy("obs_id", "crop_index").agg(F.array_sort(F.collect_list("r")).alias("all"))
    rows = rows.withColumn("good", F.filter("all", lambda r: r["accepted"]))

    def voted(r: Column) -> Column:
        same = F.filter("good", lambda o: o["dup"].eqNullSafe(r["dup"]))
        place = F.struct(F.size(same).cast("double").alias("votes"), same[0]["mean"].alias("lead"), (-same[0]["pass_index"]).alias("first"), r["mean"].alias("score"), (-r["pass_index"]).alias("pass"))
        return F.struct(place.alias("place"), r["text"].alias("text"), r["mean"].alias("mean"))

    def agreed(r: Column) -> Column:
        others = F.filter("good", lambda o: o["pass_index"] != r["pass_index"])
        like = F.aggregate(others, F.lit(0.0), lambda a, o: a + key_similarity(r["dup"], o["dup"])) / F.size(others)
        score = r["mean"] + 0.08 * F.when(F.size(others) > 0, like).otherwise(1.0) - 0.001 * F.length(r["text"])
        place = F.struct(F.lit(1.0).alias("votes"), F.lit(0.0).alias("lead"), F.lit(0).cast("long").alias("first"), score.alias("score"), (-r["pass_index"]).alias("pass"))
        return F.struct(place.alias("place"), r["text"].alias("text"), r["mean"].alias("mean"))

    def rest(r: Column) -> Column:
        place = F.struct(F.lit(0.0).alias("votes"), F.lit(0.0).alias("lead"), F.lit(0).cast("long").alias("first"), r["mean"].alias("score"), (-r["pass_index"]).alias("pass"))
        return F.struct(place.alias("place"), r["text"].alias("text"), r["mean"].alias("mean"))

    few = F.size(F.array_distinct(F.transform("good", lambda r: r["dup"]))) < F.size("good")
    picked = F.when(few, F.transform("good", voted)).when(F.size("good") > 0, F.transform("good", agreed)).otherwise(F.transform("all", rest))
    rows = rows.select("obs_id", "crop_index", F.array_max(picked).alias("p"), (F.size("good") > 0).alias("accepted"))
    return rows.select("obs_id", "crop_index", "p.text", "p.mean", "accepted")


def best_by_text(rows: DataFrame) -> DataFrame:
    """One accepted reading for each text of an observation: greatest mean, then
    first crop (and pass, if there are several); ``line_idx`` restores their order."""
    place = [c for c in ("crop_index", "pass_index") if c in rows.columns]
    w = Window.partitionBy("obs_id", T.duplicate_key("text")).orderBy(F.desc("mean"), *place)
    kept = rows.where("accepted").repartition("obs_id").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    # Both windows find an observation's rows in one place.
    order = Window.partitionBy("obs_id").orderBy(*place)
    return kept.withColumn("line_idx", F.row_number().over(order) - 1)
