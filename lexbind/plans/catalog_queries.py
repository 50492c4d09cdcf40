"""Queries over catalog building, constraints and merges, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.operators import catalog as C
from lexbind.plans.data import part_catalog, table
from lexbind.plans.text_queries import KEY

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


def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as raw metadata: names sometimes only in a nested title, makers as
    objects, grapes as a scalar or a list, years with noise."""
    k = F.col("p_partkey")
    plain = F.to_json(F.struct(k.cast("string").alias("scraped_id"), F.when(k % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("p_brand")).alias("producer"), (F.lit(1880) + k % 240).cast("string").alias("year"), F.col("p_type").alias("sugar"), F.when(k % 2 == 0, F.col("p_type")).alias("grape"), F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("category")).alias("raw_metadata"), F.struct(F.struct(F.col("p_brand").alias("name")).alias("manufacturer"), (F.col("p_size") / 2).alias("alcohol"), F.array(F.struct(F.col("p_brand").alias("name")), F.struct(F.col("p_type").alias("name"))).alias("grapes"), F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug")).alias("detailed_metadata")), {"ignoreNullFields": "false"})
    return table(spark, sf_dir, "part").select(F.parse_json(plain).alias("raw"))


@query("""
SELECT CAST(p_partkey AS VARCHAR) AS id, p_name AS name, p_brand AS producer, p_type AS style,
       CASE WHEN p_partkey % 2 = 0 THEN p_type || '|' || p_brand ELSE p_brand || '|' || p_type END AS grapes,
       CASE WHEN 1880 + p_partkey % 240 BETWEEN 1900 AND 2099 THEN CAST(1880 + p_partkey % 240 AS BIGINT) END AS year,
       CASE WHEN p_size > 0 AND p_size < 60 THEN p_size / 2.0::DOUBLE END AS alcohol, replace(p_name, ' ', '-') AS slug FROM part
""")
def catalog_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = C.build_catalog(_raw(spark, sf_dir))
    return rows.select("id", "name", "producer", F.array_join("style", "|").alias("style"), F.array_join("grapes", "|").alias("grapes"), F.col("year").cast("long").alias("year"), F.col("alcohol_percent").alias("alcohol"), "slug")


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS id, 'name' AS source, p_name AS text, {KEY('p_name')} AS key FROM part")
def alias_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.alias_rows(C.build_catalog(_raw(spark, sf_dir)))


@query("SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def dup_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.duplicate_keys(table(spark, sf_dir, "part"), "p_name")


@query("""
SELECT id, reason FROM (SELECT CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 500 AS VARCHAR) END AS id,
  CASE WHEN p_partkey % 7 = 0 THEN 'schema version' WHEN p_partkey % 11 = 0 THEN 'missing id' WHEN p_partkey % 13 = 0 THEN 'missing name' END AS reason FROM part) WHERE reason IS NOT NULL
UNION ALL SELECT id, 'duplicate id' FROM (SELECT CAST(p_partkey % 500 AS VARCHAR) AS id FROM part WHERE p_partkey % 11 <> 0) GROUP BY id HAVING count(*) > 1
""")
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.when(k % 7 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 11 != 0, (k % 500).cast("string")).alias("id"), F.when(k % 13 == 0, " ").otherwise(F.col("p_name")).alias("name"))
    return C.catalog_problems(rows)


@query(f"""
WITH a AS (SELECT CASE WHEN p_partkey % 5 = 0 THEN 'x' ELSE 'manual:' END || p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN ' ' ELSE p_name END AS name, p_type AS grape, p_name AS alias FROM part)
SELECT id, CASE WHEN id NOT LIKE 'manual:%' THEN 'id' WHEN trim(name) = '' THEN 'name' WHEN length({KEY('alias')}) < 9 THEN 'alias' END AS reason FROM a
WHERE id NOT LIKE 'manual:%' OR trim(name) = '' OR length({KEY('alias')}) < 6
""")
def addition_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(F.concat(F.when(k % 5 == 0, "x").otherwise("manual:"), k.cast("string")).alias("id"), F.when(k % 7 == 0, " ").otherwise(F.col("p_name")).alias("name"), F.array("p_type").alias("grapes"), F.array("p_name").alias("aliases"))
    return C.addition_problems(rows, part_catalog(spark, sf_dir))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as the base and suppliers as new rows, keyed by a slug."""
    base = table(spark, sf_dir, "customer").select(F.concat(F.lit("s-"), (F.col("c_custkey") % 40).cast("string"), F.lit("-"), F.col("c_custkey").cast("string")).alias("slug"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name"), F.lit("w").alias("producer"))
    rows = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), (F.col("s_suppkey") % 40).cast("string"), F.lit("-"), (F.col("s_suppkey") * 31).cast("string")).alias("slug"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 2 == 0, "w").otherwise("v").alias("producer"))
    return base, rows


_SIDES = """
base AS (SELECT 's-' || (c_custkey % 40) || '-' || c_custkey AS slug, 'n' || c_nationkey AS name, 'w' AS producer FROM customer),
fresh AS (SELECT 's-' || (s_suppkey % 40) || '-' || (s_suppkey * 31) AS slug, 'n' || s_nationkey AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'w' ELSE 'v' END AS producer FROM supplier)
"""


@query(f"WITH {_SIDES} SELECT slug, b.name AS base_name, b.producer AS base_producer, f.name AS new_name, f.producer AS new_producer FROM base b JOIN fresh f USING (slug) WHERE b.name IS DISTINCT FROM f.name OR b.producer IS DISTINCT FROM f.producer")
def merge_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.merge_conflicts(*_sides(spark, sf_dir), "slug", ["name", "producer"])


@query(f"WITH {_SIDES} SELECT DISTINCT slug, name, producer FROM fresh ANTI JOIN base USING (slug)")
def merge_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.new_rows(*_sides(spark, sf_dir), "slug")


@query("SELECT s_nationkey AS slug, count(*) AS versions FROM supplier GROUP BY 1 HAVING count(*) > 1")
def conflicting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.conflicting_rows(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("slug"), "s_name", "s_suppkey"), "slug")


@query(f"""
WITH {_SIDES}, n AS (SELECT DISTINCT slug FROM fresh ANTI JOIN base USING (slug)), old AS (SELECT slug, 7000 + row_number() OVER (ORDER BY slug) AS id FROM n WHERE slug LIKE '%1'),
rest AS (SELECT slug, (SELECT coalesce(max(id), 6999) FROM old) + row_number() OVER (ORDER BY slug) AS id FROM n WHERE slug NOT IN (SELECT slug FROM old))
SELECT slug, CAST(id AS BIGINT) AS assigned_id FROM old UNION ALL SELECT slug, CAST(id AS BIGINT) FROM rest
""")
def merge_assign_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of an earlier run (slugs ending in 1) stay; the rest get the next ones."""
    fresh = C.new_rows(*_sides(spark, sf_dir), "slug").select("slug").distinct()
    none = spark.createDataFrame([], "slug string, assigned_id long")
    earlier = C.assign_ids(fresh.where("slug like '%1'"), none, "slug", 7001).select("slug", "assigned_id")
    return C.assign_ids(fresh, earlier, "slug", 7000).select("slug", "assigned_id")


@query("""
SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN 'candidate' ELSE p_name END AS name, p_brand AS producer, l_partkey % 3 <> 0 AS known
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND l_partkey % 3 <> 0
""")
def enrich_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.when(F.col("l_partkey") % 3 == 0, F.concat(F.lit("x"), F.col("l_partkey").cast("string"))).otherwise(F.col("l_partkey").cast("string")).alias("id"), F.lit("candidate").alias("name"))
    return C.enrich(rows, part_catalog(spark, sf_dir), ["name", "producer"]).select("l_orderkey", "l_linenumber", "name", "producer", "known")


@query("SELECT c_custkey, trim(c_name) AS name, lower(c_mktsegment) AS grapes FROM customer")
def csv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("assigned_id"), F.col("c_name").alias("name"), F.lit("").alias("category"), F.lit("").alias("color"), F.lit("").alias("region"), F.concat(F.lit(" , "), F.lower("c_mktsegment"), F.lit(",")).alias("grapes"), F.lit("").alias("description"), F.lit("p").alias("producer"), F.lit("s").alias("slug"), F.lit("").alias("photo"))
    return C.csv_record(rows).select(F.col("scraped_id").cast("long").alias("c_custkey"), "name", F.array_join("grape", "|").alias("grapes"))


@query("SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0 AND NOT (c_custkey % 2 = 0 AND c_custkey % 3 = 0)")
def enrichment_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k, F.when(k % 5 != 0, "s").otherwise("").alias("slug"), F.when(k % 2 == 0, 2001).alias("year"), F.when(k % 3 == 0, 4.5).alias("rating"))
    return C.to_enrich(rows).select("c_custkey")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 2 = 0 OR event_id % 4 = 1")
def wrapped_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of bare lists, wrapper objects and other payloads."""
    e = F.col("event_id")
    item = F.concat(F.lit('{"id":'), e.cast("string"), F.lit(',"p":'), F.col("props"), F.lit("}"))
    payload = F.when(e % 2 == 0, F.concat(F.lit("["), item, F.lit(",3]"))).when(e % 4 == 1, F.concat(F.lit('{"items":1,"results":['), item, F.lit("]}"))).otherwise(F.lit('{"other":1}'))
    rows = table(spark, sf_dir, "events").select(F.explode(C.first_of(F.parse_json(payload), ("items", "results", "data"))).alias("v"))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT"))
    return rows.select(F.try_variant_get("v", "$.id", "long").alias("event_id"), F.try_variant_get("v", "$.p.k", "long").alias("k"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'data' WHEN 1 THEN 'list' ELSE 'results' END AS source FROM events WHERE event_id % 4 <> 3")
def paged_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects out of pages whose first wrapper may be empty."""
    e = F.col("event_id")

    def page(source: str) -> Column:
        items = F.when(e % 4 == 3, F.lit("[]")).otherwise(F.concat(F.lit('[{"id":'), e.cast("string"), F.lit(f',"source":"{source}"}}]')))
        other = {"data": '{"items":[],"wines":[{"id":-1}],"data":', "results": '{"items":null,"data":[],"results":'}.get(source, "")
        return F.concat(F.lit(other), items, F.lit("}" if other else ""))

    payload = F.when(e % 3 == 0, page("data")).when(e % 3 == 1, page("list")).otherwise(page("results"))
    # An empty "data" falls through to "wines", whose object is left out here.
    rows = table(spark, sf_dir, "events").select(F.explode(C.first_filled(F.parse_json(payload))).alias("v"))
    return rows.select(F.try_variant_get("v", "$.id", "long").alias("event_id"), F.try_variant_get("v", "$.source", "string").alias("source")).where("event_id >= 0")


@query("""
SELECT p_partkey AS position, CASE WHEN p_partkey % 3 = 0 THEN 'c' || p_partkey WHEN p_partkey % 3 = 1 THEN CAST(p_partkey AS VARCHAR) ELSE CAST(p_partkey + 1 AS VARCHAR) END AS scraped_id,
       CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_type END AS name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(1990 + p_size AS VARCHAR) END AS year,
       CASE WHEN p_partkey % 4 = 0 THEN p_name || '|' || p_type WHEN p_partkey % 4 = 1 THEN p_brand END AS grapes FROM part
""")
def scraped_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraped items with zeros, empty texts and lists: each member is the first that says anything."""
    k = F.col("p_partkey")

    def text(c) -> Column:
        return F.concat(F.lit('"'), c, F.lit('"'))

    members = {
        "id": F.when(k % 3 == 1, k.cast("string")).otherwise("0"), "code": F.when(k % 3 == 0, F.concat(F.lit('"c'), k, F.lit('"'))).otherwise('""'),
        "name": F.when(k % 2 == 0, text(F.col("p_name"))).otherwise("null"), "title": text(F.col("p_type")),
        "year": F.when(k % 5 == 0, "0").otherwise('""'), "vintage": F.when(k % 5 == 0, "false").otherwise((F.col("p_size") + 1990).cast("string")),
        "grape": F.when(k % 4 == 0, F.concat(F.lit('["'), F.col("p_name"), F.lit('","'), F.col("p_type"), F.lit('"]'))).otherwise("[]"),
        "varieties": F.when(k % 4 == 1, text(F.col("p_brand"))).otherwise("{}"),
    }
    item = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), c) for n, c in members.items()]), F.lit("}"))
    rows = table(spark, sf_dir, "part").select("p_partkey", F.parse_json(item).alias("raw"))
    made = C.scraped_record("raw", k)
    listed = F.try_variant_get(made["grape"], "$", "array<string>")
    grapes = F.coalesce(F.array_join(listed, "|"), F.try_variant_get(made["grape"], "$", "string"))
    return rows.select(k.alias("position"), made["scraped_id"].alias("scraped_id"), made["name"].alias("name"), made["year"].alias("year"), grapes.alias("grapes"))
