"""Queries over sampling, splits, evaluation and fonts, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.operators import evaluation as V
from lexbind.operators import sampling as S
from lexbind.plans.data import printed_lines, table
from lexbind.plans.text_queries import LINES

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


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY lang) - 1 AS pos, lang AS pool, count(*) / CAST(sum(count(*)) OVER () AS DOUBLE) AS ratio FROM documents GROUP BY lang),
f AS (SELECT *, CAST(floor(ratio * 777) AS BIGINT) AS base, ratio * 777 - floor(ratio * 777) AS part FROM p),
r AS (SELECT *, row_number() OVER (ORDER BY part DESC, pos) AS n, 777 - sum(base) OVER () AS rest FROM f)
SELECT pos, pool, CAST(base + CASE WHEN n <= rest THEN 1 ELSE 0 END AS BIGINT) AS count FROM r
""")
def alloc_largest_remainder(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    total = docs.count()
    sizes = docs.groupBy("lang").agg((F.count("*") / total).alias("ratio")).withColumnRenamed("lang", "pool")
    pools = spark.createDataFrame([(k, *r) for k, r in enumerate(sorted(tuple(r) for r in sizes.collect()))], "pos long, pool string, ratio double")  # one row a pool
    return S.largest_remainder(pools, 777).select("pos", "pool", F.col("count").cast("long").alias("count"))


@query("""
WITH c AS (SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(text, '[ªµºÀ-ÖØ-öø-ɏ]')) AS e FROM documents GROUP BY lang)
SELECT lang, n, CASE WHEN e > 0 THEN greatest(1, CAST(round_even(n * 0.25::DOUBLE, 0) AS BIGINT)) ELSE 0 END AS extended FROM c
""")
def extended_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.col("text").rlike(r"[\p{L}&&[^\x00-\x7F]]").cast("long")).alias("e"))
    return rows.select("lang", "n", S.split_extended(F.col("n"), F.col("e")).cast("long").alias("extended"))


@query("""
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey % 2 = 0 THEN 'french' WHEN c_custkey % 4 < 2 AND c_custkey % 3 = 0 THEN 'multilingual' WHEN c_custkey % 5 = 0 THEN 'latin' ELSE 'flat' END AS pool FROM customer
""")
def font_pool_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    wanted = F.when(k % 4 == 0, "french").when(k % 4 == 1, "cyrillic").otherwise("none")
    have = F.array_compact(F.array(F.when(k % 4 == 0, "french"), F.when(k % 3 == 0, "multilingual"), F.when(k % 5 == 0, "latin")))
    return table(spark, sf_dir, "customer").select("c_custkey", S.font_pool(wanted, have).alias("pool"))


@query("""
WITH h AS (SELECT p_partkey, substr(sha256('42|job|' || p_partkey || '.png'), 1, 16) AS d FROM part)
SELECT p_partkey, CAST(CAST(('0x' || substr(d, 15, 2) || substr(d, 13, 2) || substr(d, 11, 2) || substr(d, 9, 2) || substr(d, 7, 2) || substr(d, 5, 2) || substr(d, 3, 2) || substr(d, 1, 2)) AS UBIGINT) AS VARCHAR) AS seed FROM h
""")
def hash_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    seed = S.item_seed(F.lit(42), F.lit("job"), F.concat(F.col("p_partkey").cast("string"), F.lit(".png")))
    return table(spark, sf_dir, "part").select("p_partkey", seed.cast("string").alias("seed"))


_SAMPLES = f"{LINES}, s AS (SELECT obs_id * 10000 + line_idx AS sample_id, lines.text AS label, lang AS pool FROM lines JOIN documents ON doc_id = obs_id)"


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("obs_id"), F.col("lang").alias("pool"))
    # Digests, not lines, meet the pools.
    rows = printed_lines(spark, sf_dir).select("obs_id", (F.col("obs_id") * 10000 + F.col("line_idx")).alias("sample_id"), S.label_key("text", 7).alias("label_key"))
    return rows.join(docs, "obs_id").select("sample_id", "label_key", "pool")


@query(f"""
WITH {_SAMPLES}, g AS (SELECT lower(label) AS g, arg_min(pool, sample_id) AS p, count(*) AS n, sha256('7|' || lower(label)) AS h FROM s GROUP BY 1),
w AS (SELECT *, sum(n) OVER (PARTITION BY p ORDER BY h, g ROWS UNBOUNDED PRECEDING) - n AS before, greatest(1, CAST(round_even(sum(n) OVER (PARTITION BY p) * 0.1::DOUBLE, 0) AS BIGINT)) AS target,
  count(*) OVER (PARTITION BY p) - row_number() OVER (PARTITION BY p ORDER BY h, g) + 1 AS rest FROM g)
SELECT sample_id, CASE WHEN before < target AND rest > 1 THEN 'val' ELSE 'train' END AS fold FROM s JOIN w ON lower(label) = w.g
""")
def grouped_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.grouped_split(_samples(spark, sf_dir), 0.1, 7).select("sample_id", "fold")


@query("SELECT CAST(0 AS BIGINT) AS leaked")
def split_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.leakage(S.grouped_split(_samples(spark, sf_dir), 0.1, 7)).agg(F.count("*").alias("leaked"))


@query("SELECT p_brand, sha256(string_agg(lower(p_name), chr(10) ORDER BY lower(p_name))) AS fingerprint FROM part GROUP BY p_brand")
def sha_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fingerprint(table(spark, sf_dir, "part"), ["p_brand"], "p_name")


@query("SELECT p_partkey, CAST(variant AS BIGINT) AS variant FROM part, range(0, 4) v(variant)")
def variant_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.with_variants(table(spark, sf_dir, "part").select("p_partkey"), 3).withColumn("variant", F.col("variant").cast("long"))


@query("""
SELECT page_id, p_name FROM pages LEFT JOIN part ON page_id % 3 <> 0 AND p_partkey = page_id
""")
def metadata_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select("page_id", F.concat(F.when(F.col("page_id") % 3 == 0, "other_").otherwise("label_"), F.col("page_id").cast("string"), F.lit(".png")).alias("filename"))
    meta = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"), "p_name")
    return S.metadata_of(files, meta, r"label_(\d+)").select("page_id", "p_name")


@query("""
WITH r AS (SELECT p_type AS pool, p_name AS label, CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'a') WHEN p_partkey % 5 = 0 THEN upper(p_name) ELSE p_name END AS pred, p_size AS c FROM part)
SELECT pool, count(*) AS samples, round(sum(levenshtein(label, pred)) / CAST(sum(greatest(1, length(label))) AS DOUBLE), 6) AS cer, round(avg(CAST(label = pred AS INT)), 6) AS exact_match, round(avg(CAST(lower(label) = lower(pred) AS INT)), 6) AS casefold_exact_match, round(avg(c), 6) AS mean_confidence
FROM r GROUP BY GROUPING SETS ((), (pool))
""")
def cer_by_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pred = F.when(k % 3 == 0, F.replace("p_name", F.lit("e"), F.lit("a"))).when(k % 5 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select(F.col("p_type").alias("pool"), F.col("p_name").alias("label"), pred.alias("prediction"), F.col("p_size").cast("double").alias("confidence"))
    out = V.error_rates(rows)
    return out.select("pool", "samples", *[F.round(c, 6).alias(c) for c in ("cer", "exact_match", "casefold_exact_match", "mean_confidence")])


@query("SELECT lang, count(*) AS samples, CAST(min(length(text)) AS BIGINT) AS least, CAST(max(length(text)) AS BIGINT) AS greatest, round(avg(length(text)), 6) AS mean FROM documents GROUP BY lang")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = V.length_stats(table(spark, sf_dir, "documents"), "lang", "text")
    return rows.select("lang", "samples", F.col("least").cast("long").alias("least"), F.col("greatest").cast("long").alias("greatest"), F.round("mean", 6).alias("mean"))


@query("SELECT CAST(length(text) // 200 * 200 AS BIGINT) AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.length_histogram(table(spark, sf_dir, "documents"), "text", 200)


@query("""
SELECT event_type, round(median(value), 6) AS median, list_sort(list(value))[CAST(floor(0.95::DOUBLE * (count(*) - 1)) AS BIGINT) + 1] AS p95, max(value) AS greatest FROM events GROUP BY event_type
""")
def timing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.timing_summary(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_type", F.round("median", 6).alias("median"), "p95", "greatest")


@query("""
WITH need AS (SELECT lang AS set_name, unnest(['a', 'é', 'ñ', 'ß', 'ü', 'z']) AS c FROM (SELECT DISTINCT lang FROM documents)),
have AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ''))) AS c FROM documents)
SELECT doc_id, set_name, round(1 - count(*) FILTER (have.c IS NULL) / 6.0::DOUBLE, 6) AS coverage, coalesce(string_agg(need.c, '' ORDER BY need.c) FILTER (have.c IS NULL), '') AS missing
FROM (SELECT doc_id FROM documents) d CROSS JOIN need LEFT JOIN have ON have.doc_id = d.doc_id AND have.c = need.c GROUP BY d.doc_id, set_name
""".replace("SELECT doc_id, set_name, round", "SELECT d.doc_id, set_name, round"))
def coverage_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fonts = docs.select(F.col("doc_id").alias("filename"), F.array_distinct(F.split(F.lower("text"), "")).alias("codepoints"))
    need = docs.select(F.col("lang").alias("set_name")).distinct().select("set_name", F.explode(F.array(*[F.lit(c) for c in "aéñßüz"])).alias("codepoint"))
    rows = V.coverage(fonts, need)
    return rows.select(F.col("filename").alias("doc_id"), "set_name", F.round("coverage", 6).alias("coverage"), F.array_join("missing", "").alias("missing"))


@query("""
WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS pos, 'f' || (l_partkey % 700) AS filename, CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN 'a' || chr(9) WHEN l_linenumber = 3 THEN repeat('x', 33) ELSE 'ok' END AS label FROM lineitem),
n AS (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY pos) AS n FROM s)
SELECT coalesce(CASE WHEN n > 1 THEN 'duplicate' WHEN CAST(substr(filename, 2) AS INT) >= 600 THEN 'missing' WHEN label = '' THEN 'empty' WHEN contains(label, chr(9)) THEN 'control' WHEN length(label) > 32 THEN 'too_long' END, 'kept') AS reason, count(*) AS n FROM n GROUP BY 1
""")
def sample_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    ln = F.col("l_linenumber")
    label = F.when(ln == 1, "").when(ln == 2, "a\t").when(ln == 3, "x" * 33).otherwise("ok")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + ln).alias("pos"), F.concat(F.lit("f"), (F.col("l_partkey") % 700).cast("string")).alias("filename"), label.alias("label"))
    files = spark.range(600).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("filename"))
    return V.sample_reasons(rows, files).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("""
WITH RECURSIVE m AS (SELECT n_regionkey % 2 AS run, CAST(n_nationkey AS BIGINT) AS epoch, CAST(abs(12 - n_nationkey) / 100.0::DOUBLE + 0.1::DOUBLE AS DOUBLE) AS cer, 1.0::DOUBLE - n_nationkey / 100.0::DOUBLE AS exact FROM nation),
o AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS i FROM m),
f AS (
  SELECT run, epoch, i, true AS improved, cer AS c, exact AS x, epoch AS last FROM o WHERE i = 1
  UNION ALL
  SELECT o.run, o.epoch, o.i, o.cer < f.c - 1e-5 OR (abs(o.cer - f.c) <= 1e-5 AND o.exact > f.x),
         CASE WHEN o.cer < f.c OR (o.cer = f.c AND o.exact > f.x) THEN o.cer ELSE f.c END, CASE WHEN o.cer < f.c OR (o.cer = f.c AND o.exact > f.x) THEN o.exact ELSE f.x END,
         CASE WHEN o.cer < f.c - 1e-5 OR (abs(o.cer - f.c) <= 1e-5 AND o.exact > f.x) THEN o.epoch ELSE f.last END
  FROM f JOIN o ON o.run = f.run AND o.i = f.i + 1)
SELECT run, epoch, improved, epoch - last AS stale, epoch - last >= 5 AS stop FROM f
""")
def best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select((F.col("n_regionkey") % 2).alias("run"), F.col("n_nationkey").cast("long").alias("epoch"), (F.abs(F.lit(12) - F.col("n_nationkey")) / 100.0 + 0.1).alias("cer"), (F.lit(1.0) - F.col("n_nationkey") / 100.0).alias("exact"))
    return V.best_epochs(rows).select("run", "epoch", "improved", F.col("stale").cast("long").alias("stale"), "stop")
