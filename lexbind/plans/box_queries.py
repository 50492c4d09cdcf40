"""Queries over boxes and readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.operators import boxes as B
from lexbind.operators import readings as R
from lexbind.plans.data import boxes, printed_lines, readings, table
from lexbind.plans.text_queries import DUP, LINES

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


BOXES = """
b AS (SELECT l_orderkey AS obs_id, CAST(l_linenumber AS BIGINT) AS box_id, CAST(x1 AS DOUBLE) AS x1, CAST(y1 AS DOUBLE) AS y1, CAST(x1 + w AS DOUBLE) AS x2, CAST(y1 + h AS DOUBLE) AS y2
  FROM (SELECT *, (l_partkey * 7 + l_linenumber * 45) % 400 AS x1, (l_suppkey * 3 + l_orderkey % 5) % 60 AS y1,
               (CAST(l_quantity AS BIGINT) * 3 + 4) % 130 + 4 AS w, l_partkey % 22 + 4 AS h FROM lineitem))
"""
_OVER = "greatest(0, least(a.x2, c.x2) - greatest(a.x1, c.x1)) * greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1))"


@query(f"""
WITH {BOXES} SELECT obs_id, box_id FROM b WHERE x2 - x1 >= 10 AND y2 - y1 >= 7 AND (x2 - x1) * (y2 - y1) >= 100 AND NOT (x2 - x1 > 500 * 0.99 AND y2 - y1 > 100 * 0.99)
AND (x2 - x1) / greatest(y2 - y1, 1.0) BETWEEN 0.35 AND 35.0
""")
def box_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).where(B.is_valid(F.col("r"), F.col("image_w"), F.col("image_h")))
    return rows.select("obs_id", F.col("box_id").cast("long").alias("box_id"))


@query(f"""
WITH {BOXES}, p AS (SELECT a.obs_id, a.box_id AS i, c.box_id AS j, {_OVER} AS shared, (a.x2 - a.x1) * (a.y2 - a.y1) + (c.x2 - c.x1) * (c.y2 - c.y1) AS both_ FROM b a JOIN b c ON a.obs_id = c.obs_id AND a.box_id < c.box_id)
SELECT obs_id, i, j, round(shared / (both_ - shared), 6) AS iou FROM p WHERE shared > 0
""")
def box_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("obs_id", F.col("box_id").cast("long").alias("box_id"), "r")
    a, b = rows.withColumnsRenamed({"box_id": "i", "r": "ra"}), rows.withColumnsRenamed({"box_id": "j", "r": "rb"})
    pairs = a.join(b, "obs_id").where("i < j").select("obs_id", "i", "j", B.iou(F.col("ra"), F.col("rb")).alias("iou")).where("iou > 0")
    return pairs.withColumn("iou", F.round("iou", 6))


@query(f"""
WITH {BOXES}, p AS (
  SELECT a.obs_id, a.box_id AS i, c.box_id AS j, least(a.y2 - a.y1, c.y2 - c.y1) AS lo, greatest(a.y2 - a.y1, c.y2 - c.y1) AS hi, c.x1 - a.x2 AS gap,
         greatest(0, least(a.y2, c.y2) - greatest(a.y1, c.y1)) AS shared, greatest(a.x2, c.x2) - least(a.x1, c.x1) AS width
  FROM b a JOIN b c ON a.obs_id = c.obs_id AND a.box_id <> c.box_id)
SELECT obs_id, i, j, gap FROM p WHERE gap >= -0.15::DOUBLE * lo AND gap <= 2 * hi AND shared >= 0.45::DOUBLE * lo AND hi <= 1.8::DOUBLE * lo AND width <= 12 * hi
""")
def box_adjacent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = boxes(spark, sf_dir).select("obs_id", F.col("box_id").cast("long").alias("box_id"), "r")
    return B.adjacent_pairs(rows).select("obs_id", "i", "j", "gap")


def _nms_sql() -> str:
    """Greedy suppression by recursion over the boxes in area order; at most
    eight boxes an order."""
    over = _OVER.replace("a.", "b.").replace("c.", "k.")
    return f"""
WITH RECURSIVE {BOXES},
s AS (SELECT *, row_number() OVER (PARTITION BY obs_id ORDER BY (x2 - x1) * (y2 - y1) DESC, box_id) AS n FROM b),
r AS (
  SELECT obs_id, n, [{{'box_id': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}}] AS kept FROM s WHERE n = 1
  UNION ALL
  SELECT s.obs_id, s.n, CASE WHEN len(list_filter(r.kept, lambda k: ({over.replace('b.', 's.')}) / ((s.x2 - s.x1) * (s.y2 - s.y1) + (k.x2 - k.x1) * (k.y2 - k.y1) - ({over.replace('b.', 's.')})) >= 0.65)) > 0
         THEN r.kept ELSE list_append(r.kept, {{'box_id': s.box_id, 'x1': s.x1, 'y1': s.y1, 'x2': s.x2, 'y2': s.y2}}) END
  FROM r JOIN s ON s.obs_id = r.obs_id AND s.n = r.n + 1),
f AS (SELECT obs_id, arg_max(kept, n) AS kept FROM r GROUP BY obs_id)
SELECT obs_id, unnest(kept).box_id AS box_id FROM f
"""


@query(_nms_sql())
def box_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.suppress(boxes(spark, sf_dir)).select("obs_id", F.col("box_id").cast("long").alias("box_id"))


@query()
def fragment_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.fragment_groups(B.suppress(boxes(spark, sf_dir)))
    return rows.select("obs_id", F.col("pos").cast("long").alias("pos"), "r.x1", "r.y1", "r.x2", "r.y2")


@query(f"WITH {BOXES} SELECT obs_id, box_id, row_number() OVER (PARTITION BY obs_id ORDER BY y1, x1, box_id) - 1 AS place FROM b")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = B.reading_order(boxes(spark, sf_dir))
    return rows.select("obs_id", F.col("box_id").cast("long").alias("box_id"), F.col("place").cast("long").alias("place"))


#: Readings with confidences in whole percent: obs_id, crop_index, pass_index, text, conf.
READINGS = rf"""
{LINES},
r0 AS (SELECT obs_id, line_idx AS crop_index, pass_index, text, pct, (obs_id + line_idx * 3 + pass_index * 5) % 7 AS odd, length(regexp_replace(text, '\s', '', 'g')) AS n
  FROM (SELECT *, unnest([0, 1, 2]) AS pass_index FROM lines)),
r AS (SELECT obs_id, crop_index, pass_index, CASE odd WHEN 0 THEN replace(text, 'e', 'c') WHEN 1 THEN replace(text, 'o', '0') ELSE text END AS text,
  list_transform(range(1, n + 1), lambda i: 100 - (obs_id + pass_index * 11 + i * 7) % (5 + pct % 30)) AS conf FROM r0)
"""


@query(f"""
WITH {READINGS}, c AS (SELECT obs_id, crop_index, pass_index, unnest(conf) AS p FROM r)
SELECT obs_id, crop_index, CAST(pass_index AS BIGINT) AS pass_index, round(quantile_cont(p / 100.0::DOUBLE, 0.25), 6) AS quartile, min(p) / 100.0::DOUBLE AS least, round(CAST(sum(p) AS BIGINT) / CAST(100 * count(*) AS DOUBLE), 6) AS mean FROM c GROUP BY ALL
""")
def conf_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Whole percents are summed, so that the order of the sum does not matter.
    rows = readings(spark, sf_dir).select("obs_id", "crop_index", "pass_index", R.confidence("char_conf", F.lit(2**31 - 1), F.lit(True)).alias("s")).where("s.n > 0")
    mean = F.col("s.percent") / (100 * F.col("s.n"))
    return rows.select("obs_id", "crop_index", F.col("pass_index").cast("long").alias("pass_index"), F.round("s.quartile", 6).alias("quartile"), F.col("s.least").alias("least"), F.round(mean, 6).alias("mean"))


def _gate_sql() -> str:
    return rf"""
WITH {READINGS},
w AS (SELECT obs_id, crop_index, pass_index, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM r),
d AS (SELECT *, {DUP('w')} AS d, lag({DUP('w')}) OVER (PARTITION BY obs_id, crop_index, pass_index ORDER BY i) AS before FROM w),
t0 AS (SELECT obs_id, crop_index, pass_index, string_agg(w, ' ' ORDER BY i) AS text FROM d WHERE before IS NULL OR d = '' OR d <> before GROUP BY 1, 2, 3),
t AS (SELECT t0.*, r.conf FROM t0 JOIN r USING (obs_id, crop_index, pass_index)),
v AS (SELECT *, list_transform(list_slice(conf, 1, length(regexp_replace(text, '\s', '', 'g'))), lambda x: x / 100.0::DOUBLE) AS c, string_split(lower(text), '') AS ch FROM t),
q AS (SELECT *, list_sort(c) AS s, (len(c) - 1) * 0.25::DOUBLE AS spot FROM v),
g AS (SELECT *, list_reduce(c, lambda a, b: a + b) / len(c) AS mean, list_min(c) AS least,
        (s[CAST(floor(spot) AS BIGINT) + 1] + (s[least(CAST(floor(spot) AS BIGINT) + 2, len(s))] - s[CAST(floor(spot) AS BIGINT) + 1]) * (spot - floor(spot))) AS quartile,
        length(trim(text)) >= 2 AND trim(text) <> '100' AND length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[^\p{{L}}\p{{N}}]', '', 'g')) / CAST(greatest(length(regexp_replace(text, '\s', '', 'g')), 1) AS DOUBLE) >= 0.60
        AND len(list_filter(range(1, len(ch) - 2), lambda i: ch[i] = ch[i + 1] AND ch[i] = ch[i + 2] AND ch[i] = ch[i + 3])) = 0 AS looks FROM q)
"""


@query(_gate_sql() + "SELECT obs_id, crop_index, CAST(pass_index AS BIGINT) AS pass_index, text, looks AND mean >= 0.88 AND least >= 0.55 AND quartile >= 0.75 AS accepted FROM g")
def conf_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.gated(readings(spark, sf_dir))
    return rows.select("obs_id", "crop_index", F.col("pass_index").cast("long").alias("pass_index"), "text", "accepted")


@query()
def consensus_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.consensus(R.gated(readings(spark, sf_dir)))
    return rows.select("obs_id", "crop_index", "text", F.round("mean", 6).alias("mean"), "accepted")


@query(_gate_sql() + f""", a AS (SELECT obs_id, crop_index, pass_index, text, CAST(list_sum(list_transform(c, lambda x: round(x * 100))) AS BIGINT) AS total, {DUP('text')} AS d FROM g WHERE looks AND mean >= 0.88 AND least >= 0.55 AND quartile >= 0.75),
k AS (SELECT *, row_number() OVER (PARTITION BY obs_id, d ORDER BY total DESC, crop_index, pass_index) AS n FROM a)
SELECT obs_id, crop_index, CAST(pass_index AS BIGINT) AS pass_index, text, row_number() OVER (PARTITION BY obs_id ORDER BY crop_index, pass_index) - 1 AS line_idx FROM k WHERE n = 1
""")
def dedupe_best_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best reading of each text over all passes, by summed confidence so that no float decides."""
    rows = R.gated(readings(spark, sf_dir))
    kept = R.best_by_text(rows.withColumn("mean", F.col("percent").cast("double")))
    return kept.select("obs_id", "crop_index", F.col("pass_index").cast("long").alias("pass_index"), "text", F.col("line_idx").cast("long").alias("line_idx"))


@query(f"""
WITH {LINES} SELECT obs_id, line_idx AS crop_index, CAST(pass_index AS BIGINT) AS pass_index, margin FROM (SELECT obs_id, line_idx, unnest([0, 1, 2]) AS pass_index, unnest([0.0, 0.04, 0.08])::DOUBLE AS margin FROM lines)
""")
def crop_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.with_margins(printed_lines(spark, sf_dir).select("obs_id", F.col("line_idx").alias("crop_index")), 3)
    return rows.withColumn("pass_index", F.col("pass_index").cast("long"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN '1,1;9,2;8,7;2,8' ELSE '2,1;9,3;8,9;1,8' END AS corners FROM customer
""")
def quad_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of two quadrilaterals given in a scrambled order."""

    def points(*xy):
        return F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy])

    quad = F.when(F.col("c_custkey") % 2 == 0, points((8, 7), (1, 1), (2, 8), (9, 2))).otherwise(points((9, 3), (1, 8), (8, 9), (2, 1)))
    rows = table(spark, sf_dir, "customer").select("c_custkey", B.ordered_quad(quad).alias("q"))
    text = F.array_join(F.transform("q", lambda p: F.concat_ws(",", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), ";")
    return rows.select("c_custkey", text.alias("corners"))
