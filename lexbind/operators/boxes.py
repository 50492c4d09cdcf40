"""Geometry of detected text boxes: bounds, overlap, duplicates, fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least width, height, area; share of the frame; ratio of sides.
MIN_W, MIN_H, MIN_AREA, FRAME, RATIOS = 10, 7, 100, 0.99, (0.35, 35.0)
DUPLICATE_IOU, SAME_IOU = 0.65, 0.85
RECT = "struct<x1:double,y1:double,x2:double,y2:double>"


def bounds(points: Column | str) -> Column:
    """Axis-aligned bounds of a list of points."""
    p = F.col(points) if isinstance(points, str) else points
    xs, ys = F.transform(p, lambda q: q["x"]), F.transform(p, lambda q: q["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"), F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def ordered_quad(points: Column | str) -> Column:
    """Corners top-left, top-right, bottom-right, bottom-left: least and greatest
    x + y, least and greatest y - x (the first of equals)."""
    p = F.col(points) if isinstance(points, str) else points

    def pick(measure, sign):
        tagged = F.transform(p, lambda q, i: F.struct((sign * measure(q)).alias("m"), i.alias("i"), q.alias("q")))
        return F.array_min(tagged)["q"]

    plus, minus = (lambda q: q["x"] + q["y"]), (lambda q: q["y"] - q["x"])
    return F.array(pick(plus, 1), pick(minus, 1), pick(plus, -1), pick(minus, -1))


def quad(rect: Column) -> Column:
    """Corners of a rectangle."""
    return F.array(*[F.struct(rect[x].alias("x"), rect[y].alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["x2"] - r["x1"]) * F.greatest(F.lit(0.0), r["y2"] - r["y1"])


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two rectangles; 0 if both are empty."""
    w = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def is_valid(r: Column, image_w: Column, image_h: Column) -> Column:
    """Large enough, not the whole frame, not too tall or flat."""
    w, h = r["x2"] - r["x1"], r["y2"] - r["y1"]
    whole = (w > image_w * FRAME) & (h > image_h * FRAME)
    return (w >= MIN_W) & (h >= MIN_H) & (w * h >= MIN_AREA) & ~whole & (w / F.greatest(h, F.lit(1.0))).between(*RATIOS)


def suppress(boxes: DataFrame, threshold: float = DUPLICATE_IOU) -> DataFrame:
    """Greedy suppression for each observation: largest first, a box goes if it
    overlaps a kept one too much.  Input: obs_id, box_id, r (a rectangle)."""
    item = f"struct<a:double,box_id:int,r:{RECT}>"
    rows = boxes.groupBy("obs_id").agg(F.array_sort(F.collect_list(F.struct((-area(F.col("r"))).alias("a"), F.col("box_id").cast("int").alias("box_id"), F.col("r").cast(RECT).alias("r")))).alias("b"))
    kept = F.aggregate(
        "b",
        F.array().cast(f"array<{item}>"),
        lambda acc, x: F.when(F.exists(acc, lambda k: iou(k["r"], x["r"]) >= threshold), acc).otherwise(F.array_append(acc, x)),
    )
    return rows.select("obs_id", F.explode(kept).alias("k")).select("obs_id", "k.box_id", "k.r")


def adjacent_pairs(boxes: DataFrame) -> DataFrame:
    """(obs_id, i, j, height, gap, joined): j stands right of i on the same line."""
    a = boxes.select("obs_id", F.col("box_id").alias("i"), F.col("r").alias("a"))
    b = boxes.select("obs_id", F.col("box_id").alias("j"), F.col("r").alias("b"))
    h1, h2 = F.col("a.y2") - F.col("a.y1"), F.col("b.y2") - F.col("b.y1")
    low, high = F.least(h1, h2), F.greatest(h1, h2)
    gap = F.col("b.x1") - F.col("a.x2")
    overlap = F.greatest(F.lit(0.0), F.least("a.y2", "b.y2") - F.greatest("a.y1", "b.y1"))
    width = F.greatest("a.x2", "b.x2") - F.least("a.x1", "b.x1")
    near = (h1 > 0) & (h2 > 0) & gap.between(-0.15 * low, 2.0 * high) & (overlap >= 0.45 * low) & (high <= 1.8 * low) & (width <= 12 * high)
    joined = F.struct(F.least("a.x1", "b.x1").alias("x1"), F.least("a.y1", "b.y1").alias("y1"), F.greatest("a.x2", "b.x2").alias("x2"), F.greatest("a.y2", "b.y2").alias("y2"))
    return a.join(b, "obs_id").where((F.col("i") != F.col("j")) & near).select("obs_id", "i", "j", high.alias("height"), gap.alias("gap"), joined.alias("joined"))


def fragment_groups(boxes: DataFrame, most: int = 8) -> DataFrame:
    """(obs_id, pos, r): joined boxes of adjacent fragments, largest lines first,
    then joins of two that overlap in a staggered way; at most ``most``."""
    pairs = adjacent_pairs(boxes)
    lists = pairs.groupBy("obs_id").agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("height")).alias("h"), "gap", "i", "j", F.col("joined").cast(RECT).alias("r")))), lambda x: x["r"]).alias("p"))
    none = F.array().cast(f"array<{RECT}>")
    limit = max(1, most - 2)

    def add(cap: int):
        def step(acc: Column, r: Column) -> Column:
            return F.when((F.size(acc) >= cap) | F.exists(acc, lambda k: iou(r, k) > SAME_IOU), acc).otherwise(F.array_append(acc, r))

        return step

    lists = lists.withColumn("pairs", F.aggregate("p", none, add(limit)))
    order = F.flatten(F.transform("pairs", lambda a, i: F.transform(F.slice("pairs", i + 2, F.greatest(F.size("pairs") - i - 1, F.lit(0))), lambda b: F.struct(a.alias("a"), b.alias("b")))))

    def staggered(x: Column) -> Column:
        a, b = x["a"], x["b"]
        cross = ((a["x1"] < b["x1"]) & (b["x1"] < a["x2"]) & (a["x2"] < b["x2"])) | ((b["x1"] < a["x1"]) & (a["x1"] < b["x2"]) & (b["x2"] < a["x2"]))
        sx = F.greatest(F.lit(0.0), F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
        sy = F.greatest(F.lit(0.0), F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
        return cross & (sx >= 0.25 * F.least(a["x2"] - a["x1"], b["x2"] - b["x1"])) & (sy >= 0.60 * F.least(a["y2"] - a["y1"], b["y2"] - b["y1"]))

    def both(x: Column) -> Column:
        a, b = x["a"], x["b"]
        return F.struct(F.least(a["x1"], b["x1"]).alias("x1"), F.least(a["y1"], b["y1"]).alias("y1"), F.greatest(a["x2"], b["x2"]).alias("x2"), F.greatest(a["y2"], b["y2"]).alias("y2"))

    more = F.transform(F.filter(order, staggered), both)
    out = F.aggregate(F.when(F.size("pairs") > 1, more).otherwise(none), F.col("pairs"), add(most))
    return lists.select("obs_id", F.posexplode(out).alias("pos", "r"))


def reading_order(boxes: DataFrame) -> DataFrame:
    """Boxes with ``place``: top to bottom, then left to right."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("obs_id").orderBy("r.y1", "r.x1", "box_id")
    return boxes.withColumn("place", F.row_number().over(w) - 1)
