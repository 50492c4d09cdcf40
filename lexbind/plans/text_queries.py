"""Queries over text functions and lexicon pools, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexbind.functions import text as T
from lexbind.operators import evaluation, lexicon
from lexbind.plans.data import printed_lines, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def KEY(c: str) -> str:
    """SQL of :func:`lexbind.functions.text.key` on composed text."""
    return rf"trim(regexp_replace(replace(replace(lower({c}), 'ß', 'ss'), 'ё', 'е'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def ACCENTLESS(k: str) -> str:
    for a, b in T.UNDECOMPOSED.items():
        k = f"replace({k}, '{a}', '{b}')"
    return f"strip_accents({k})"


def DUP(c: str) -> str:
    return rf"regexp_replace(replace(lower({c}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]', '', 'g')"


#: The lines of documents: obs_id, line_idx, text, pct.
LINES = r"""
lines AS (
  SELECT doc_id AS obs_id, line_idx,
         array_to_string(list_filter(string_split(line, ' '), lambda w: w <> ''), ' ') AS text,
         (doc_id * 31 + line_idx * 17) % 41 + 60 AS pct
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_idx FROM documents)
  WHERE array_to_string(list_filter(string_split(line, ' '), lambda w: w <> ''), ' ') <> '')
"""


def query(sql: str | None = None):
    """Register a query, and its SQL if it has any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {KEY('text')} AS key FROM documents")
def norm_search_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.key("text").alias("key"))


@query(f"SELECT doc_id, {ACCENTLESS(KEY('text'))} AS accent FROM documents")
def norm_accent_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.accentless(T.key("text")).alias("accent"))


@query(f"""
WITH k AS (SELECT item_id, {KEY('text')} AS k FROM benchmark), f AS (SELECT item_id, k, {ACCENTLESS('k')} AS a FROM k)
SELECT item_id, CAST(0 AS BIGINT) AS form_pos, k AS form FROM f WHERE k <> ''
UNION ALL SELECT item_id, CAST(1 AS BIGINT), a FROM f WHERE a <> k AND a <> ''
""")
def search_forms_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.forms("text")).alias("form_pos", "form"))
    return rows.withColumn("form_pos", F.col("form_pos").cast("long"))


@query(f"""
WITH t AS (SELECT doc_id, unnest(string_split({KEY('text')}, ' ')) AS w FROM documents)
SELECT doc_id, count(*) AS n_tokens, count(DISTINCT w) AS n_distinct, count(*) FILTER (length(w) >= 3 AND regexp_matches(w, '\\p{{L}}')) AS n_indexable
FROM t WHERE w <> '' GROUP BY doc_id
""")
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = T.tokens(T.key("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") > 0)
    return rows.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"), F.size(F.filter("w", T.is_indexable)).cast("long").alias("n_indexable"))


@query(f"""
WITH t AS (SELECT unnest(string_split({KEY('text')}, ' ')) AS w FROM documents)
SELECT CASE WHEN regexp_matches(w, '\\p{{Latin}}') AND regexp_matches(w, '\\p{{Cyrillic}}') THEN 'mixed' WHEN regexp_matches(w, '\\p{{Latin}}') THEN 'latin'
            WHEN regexp_matches(w, '\\p{{Cyrillic}}') THEN 'cyrillic' WHEN regexp_matches(w, '\\p{{Nd}}') THEN 'numeric' ELSE 'other' END AS script, count(*) AS n
FROM t WHERE w <> '' GROUP BY 1
""")
def script_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select(F.explode(T.tokens(T.key("text"))).alias("w"))
    return words.groupBy(T.script("w").alias("script")).agg(F.count("*").alias("n"))


_USABLE = r"length(t) >= 2 AND NOT regexp_matches(t, '(?i)https?:|www\.') AND NOT contains(t, chr(92)) AND length(t) - length(replace(t, '/', '')) <= 2 AND regexp_matches(t, '[\p{L}\p{N}]')"


@query(f"""
WITH v AS (SELECT url AS t FROM pages UNION ALL SELECT p_name FROM part UNION ALL SELECT replace(url, 'http', 'x') FROM pages)
SELECT {_USABLE} AS usable, count(*) AS n FROM v GROUP BY 1
""")
def usable_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    v = pages.select(F.col("url").alias("t")).union(table(spark, sf_dir, "part").select("p_name")).union(pages.select(F.replace("url", F.lit("http"), F.lit("x"))))
    return v.groupBy(T.is_usable("t").alias("usable")).agg(F.count("*").alias("n"))


@query(f"SELECT conv_id, turn, {DUP('text')} AS dup_key FROM conversations")
def dup_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.duplicate_key("text").alias("dup_key"))


@query(f"""
WITH {LINES},
w AS (SELECT obs_id, line_idx, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM lines),
d AS (SELECT *, {DUP('w')} AS d, lag({DUP('w')}) OVER (PARTITION BY obs_id, line_idx ORDER BY i) AS before FROM w)
SELECT obs_id, line_idx, string_agg(w, ' ' ORDER BY i) AS text FROM d WHERE before IS NULL OR d = '' OR d <> before GROUP BY ALL
""")
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return printed_lines(spark, sf_dir).select("obs_id", "line_idx", T.collapse_repeats("text").alias("text"))


@query("""
WITH n AS (SELECT unnest(regexp_extract_all('lot ' || strftime(l_shipdate, '%Y-%m-%d') || '/' || CAST(l_orderkey AS VARCHAR), '[0-9]+')) AS y FROM lineitem)
SELECT y AS year, count(*) AS n FROM n WHERE length(y) = 4 AND (y LIKE '19%' OR y LIKE '20%') GROUP BY 1
""")
def year_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("lot "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("/"), F.col("l_orderkey").cast("string")).alias("t"))
    return t.select(F.explode(T.years("t")).alias("year")).groupBy("year").agg(F.count("*").alias("n"))


@query(r"""
SELECT doc_id, round(CAST(length(regexp_replace(regexp_replace(text, '\s', '', 'g'), '[^\p{L}\p{N}]', '', 'g')) AS DOUBLE) / greatest(length(regexp_replace(text, '\s', '', 'g')), 1), 6) AS ratio
FROM documents
""")
def alnum_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.round(T.alnum_ratio("text"), 6).alias("ratio"))


@query("""
WITH c AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS c, generate_subscripts(string_split(lower(text), ''), 1) AS i FROM documents),
g AS (SELECT doc_id, c, lag(c, 1) OVER w AS a, lag(c, 2) OVER w AS b, lag(c, 3) OVER w AS d FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT DISTINCT doc_id FROM g WHERE c = a AND a = b AND b = d
""")
def run_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(T.has_run("text")).select("doc_id")


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(T.chunk_phrase(T.lexicon_clean("text"), 32)).alias("pos", "phrase"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query(f"""
WITH k AS (SELECT p_brand, p_name, p_partkey, {KEY('p_name')} AS key FROM part)
SELECT p_brand, key, arg_min(p_name, p_partkey) AS first_name FROM k WHERE key <> '' GROUP BY 1, 2
""")
def distinct_text_firstwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda s: s["p_name"]).alias("names"))
    rows = names.select("p_brand", F.explode(T.distinct_text("names")).alias("first_name"))
    return rows.select("p_brand", T.key("first_name").alias("key"), "first_name")


@query(f"""
WITH v AS (SELECT p_partkey, p_name || ', ' || p_type AS full_name, p_type FROM part)
SELECT p_partkey, substr(full_name, 1, length(full_name) - length(p_type) - 2) AS stripped, {KEY('full_name')} AS key FROM v
""")
def strip_known_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    rows = part.select("p_partkey", F.concat("p_name", F.lit(", "), "p_type").alias("full_name"))
    stripped = lexicon.strip_suffixes(rows, "full_name", part.select(F.col("p_type").alias("term")))
    return stripped.select("p_partkey", "stripped", T.key("full_name").alias("key"))


@query("SELECT p_partkey, p_name AS short_name FROM part")
def name_without_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", T.without_style(F.concat("p_name", F.lit(" "), "p_type"), F.array("p_type")).alias("short_name"))


_PATH = r"regexp_replace(regexp_replace(regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*', ''), '[?#].*$', ''), '^/+', '')"


@query(f"SELECT page_id, {_PATH} AS path, lower(regexp_extract({_PATH}, '(\\.[A-Za-z0-9]+)$', 1)) AS suffix FROM pages")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", T.url_path("url").alias("path"), T.url_suffix("url").alias("suffix"))


@query(f"""
WITH s AS (SELECT page_id, replace({_PATH}, '/', '-') || '-label' AS slug FROM pages)
SELECT page_id, CASE WHEN regexp_matches(slug, '^[A-Za-z0-9_\\-]+$') AND length({KEY('slug')}) >= 6 AND len(string_split({KEY('slug')}, ' ')) >= 2
       THEN replace(replace(slug, '_', ' '), '-', ' ') END AS name FROM s
""")
def slug_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    slug = F.concat(F.replace(T.url_path("url"), F.lit("/"), F.lit("-")), F.lit("-label"))
    return table(spark, sf_dir, "pages").select("page_id", T.name_from_slug(slug).alias("name"))


@query(r"""
WITH w AS (SELECT unnest(string_split(trim(regexp_replace(regexp_replace(text, '[^\p{L}\p{N}_\s\-.%]', '', 'g'), '\s+', ' ', 'g')), ' ')) AS word FROM conversations)
SELECT word, count(*) AS n FROM w WHERE word <> '' GROUP BY 1
""")
def vocabulary_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.word_counts(table(spark, sf_dir, "conversations"), "text")


@query("SELECT lang, count(*) FILTER (regexp_matches(text, '[ªµºÀ-ÖØ-öø-ɏ]')) AS extended, count(*) AS n FROM documents GROUP BY lang")
def extended_latin_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").groupBy("lang")
    return rows.agg(F.coalesce(F.sum(T.extended_latin("text").cast("long")), F.lit(0)).alias("extended"), F.count("*").alias("n"))


@query("""
SELECT p_partkey, CASE WHEN p_size > 0 AND p_size < 60 THEN CASE WHEN p_size % 2 = 0 THEN CAST(p_size // 2 AS VARCHAR) ELSE CAST(p_size // 2 AS VARCHAR) || '.5' END || '% vol' END AS strength FROM part
""")
def alcohol_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", T.alcohol_text(F.col("p_size") / 2).alias("strength"))


_CHUNKS = "SELECT DISTINCT p_name AS phrase FROM part UNION SELECT DISTINCT p_type FROM part"


@query(f"""
WITH p AS ({_CHUNKS}), v AS (SELECT phrase FROM p UNION SELECT upper(phrase) FROM p)
SELECT pool, phrase FROM (SELECT unnest(['latin', 'alphabetic', 'all']) AS pool, phrase FROM v)
UNION ALL SELECT unnest(['numeric', 'all']) AS pool, CAST(y AS VARCHAR) FROM range(1991, 2041) t(y)
""")
def pool_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.pools(lexicon.phrases(_values(spark, sf_dir)))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    null = F.lit(None).cast("string")
    names = part.select(F.col("p_name").alias("value"), F.lit("name").alias("origin"), null.alias("pool"))
    types = part.select("p_type", F.lit("category"), null)
    years = spark.range(1991, 2041).select(F.col("id").cast("string"), F.lit("vintage"), F.lit("numeric"))
    return names.union(types).union(years)


@query("""
SELECT 'name' AS origin, 'latin' AS pool, count(*) AS n FROM part UNION ALL SELECT 'category', 'latin', count(*) FROM part UNION ALL SELECT 'vintage', 'numeric', 50
""")
def origin_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon.origin_counts(lexicon.phrases(_values(spark, sf_dir)))


@query(f"""
WITH a AS (SELECT DISTINCT unnest(string_split({KEY('text')}, ' ')) AS w FROM benchmark), b AS (SELECT DISTINCT unnest(string_split({KEY('text')}, ' ')) AS w FROM conversations)
SELECT 'both' AS part, w FROM (SELECT w FROM a INTERSECT SELECT w FROM b) UNION ALL SELECT 'missing', w FROM (SELECT w FROM a EXCEPT SELECT w FROM b)
""")
def pool_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "benchmark").select(F.explode(T.tokens(T.key("text"))).alias("w"))
    b = table(spark, sf_dir, "conversations").select(F.explode(T.tokens(T.key("text"))).alias("w"))
    return a.intersect(b).select(F.lit("both").alias("part"), "w").union(a.subtract(b).select(F.lit("missing"), "w"))


@query("""
SELECT string_agg(c, '' ORDER BY c) AS unseen FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM benchmark) WHERE NOT contains('abcdefghijklmnopqrstuvwxyz', c)
""")
def charset_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = "abcdefghijklmnopqrstuvwxyz"
    made = lexicon.charset(table(spark, sf_dir, "benchmark"), base, "text")
    return spark.createDataFrame([(made[len(base) :],)], "unseen string")


@query("""
SELECT doc_id, sha256(text) AS content_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS place, count(*) OVER (PARTITION BY sha256(text)) AS copies FROM documents
""")
def content_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = evaluation.dedupe_content(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id")
    return rows.select("doc_id", "content_hash", F.col("place").cast("long").alias("place"), "copies")
