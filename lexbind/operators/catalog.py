"""Catalog records from raw metadata, their constraints, and merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexbind.functions import text as T
from lexbind.operators.order import running

VERSION = 1
#: Shortest alias keys: titles, and names derived from others.
TITLE_KEY, DERIVED_KEY = 2, 4


class ConstraintError(ValueError):
    """Rows break a constraint; the message names the first ones."""


def require_none(bad: DataFrame, what: str, shown: int = 5) -> None:
    """Fail if a constraint query returns rows."""
    rows = bad.take(shown)
    if rows:
        raise ConstraintError(f"{what}: {[r.asDict(True) for r in rows]}")


def first_text(*columns: Column) -> Column:
    """The first column with something other than white space, trimmed, or null."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


#: Members that wrap a list, in order (fixed values).
WRAPPERS = ("wines", "items", "results", "data")


def first_of(payload: Column | str, names: tuple[str, ...] = WRAPPERS) -> Column:
    """A VARIANT list, or the first member of an object among ``names`` that is a list."""
    v = F.col(payload) if isinstance(payload, str) else payload
    members = [F.try_variant_get(v, f"$.{n}", "array<variant>") for n in names]
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), *members, F.array().cast("array<variant>"))


#: Members that wrap the list of a page, in order (fixed values).
PAGE_WRAPPERS = ("items", "data", "wines", "results")


def first_filled(payload: Column | str, names: tuple[str, ...] = PAGE_WRAPPERS) -> Column:
    """A VARIANT list, or an object's first member among ``names`` that is a list with
    anything in it."""
    v = F.col(payload) if isinstance(payload, str) else payload
    lists = [F.try_variant_get(v, p, "array<variant>") for p in ("$", *(f"$.{n}" for n in names))]
    return F.coalesce(*[F.when(F.size(x) > 0, x) for x in lists], F.array().cast("array<variant>"))


def filled(v: Column) -> Column:
    """Whether a VARIANT says anything: not null, empty text or list or object, zero or false."""
    text, kind = F.to_json(v), F.schema_of_variant(v)
    zero = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (F.try_variant_get(v, "$", "double") == 0)
    return F.coalesce(~text.isin("null", '""', "[]", "{}", "false") & ~F.coalesce(zero, F.lit(False)), F.lit(False))


def record(raw: Column | str) -> dict[str, Column]:
    """Catalog columns of a raw metadata VARIANT."""
    v = F.col(raw) if isinstance(raw, str) else raw

    def text(path: str) -> Column:
        return F.try_variant_get(v, path, "string")

    def nested(path: str) -> Column:
        return F.coalesce(F.try_variant_get(v, f"{path}.name", "string"), text(path))

    name = first_text(text("$.name"), text("$.raw_metadata.title"), text("$.detailed_metadata.title"))
    producer = first_text(text("$.producer"), text("$.raw_metadata.manufacturer"), nested("$.detailed_metadata.manufacturer"))
    region = first_text(text("$.region"), text("$.raw_metadata.region"), nested("$.detailed_metadata.region"))
    styles = T.distinct_text(F.array(text("$.sugar"), text("$.raw_metadata.category"), nested("$.detailed_metadata.category")))
    grapes = T.distinct_text(
        F.concat(
            F.coalesce(F.transform(F.try_variant_get(v, "$.grape", "array<variant>"), T.nested_name), F.array(nested("$.grape"))),
            F.coalesce(F.transform(F.try_variant_get(v, "$.detailed_metadata.grapes", "array<variant>"), T.nested_name), F.array().cast("array<string>")),
        )
    )
    alcohol = F.try_variant_get(v, "$.detailed_metadata.alcohol", "double")
    number = ~F.schema_of_variant(F.try_variant_get(v, "$.detailed_metadata.alcohol", "variant")).isin("BOOLEAN", "STRING")
    return {
        "id": text("$.scraped_id"),
        "name": name,
        "producer": producer,
        "region": region,
        "style": styles,
        "color": first_text(text("$.color")),
        "grapes": grapes,
        "year": T.catalog_year(text("$.year")),
        "alcohol_percent": F.when(number & (alcohol > 0) & (alcohol < 30), alcohol),
        "slug": first_text(text("$.detailed_metadata.slug"), text("$.raw_metadata.slug")),
        "image_url": first_text(text("$.remote_image_url")),
        "_raw_title": text("$.raw_metadata.title"),
        "_detailed_title": text("$.detailed_metadata.title"),
    }


def admitted_aliases(name: Column, raw_title: Column, detailed_title: Column, styles: Column, slug: Column) -> Column:
    """Aliases (text, key, source): the titles, the name without a style, the
    slug's words; long enough, first source of a key wins."""
    empty = F.array().cast("array<struct<text:string,key:string,source:string>>")
    sources = [("name", name, TITLE_KEY), ("raw_title", raw_title, TITLE_KEY), ("detailed_title", detailed_title, TITLE_KEY)]
    sources += [("name_without_style", T.without_style(name, styles), DERIVED_KEY), ("slug", T.name_from_slug(slug), DERIVED_KEY)]
    offered = F.array(*[F.struct(t.alias("text"), F.lit(source).alias("source"), F.lit(least).alias("least")) for source, t, least in sources])
    # Each text's key is made once; the fold only compares keys.
    keyed = F.transform(offered, lambda e: F.struct(T.display(e["text"]).alias("text"), T.key(e["text"]).alias("key"), e["source"].alias("source"), e["least"].alias("least")))
    entries = F.transform(F.filter(keyed, lambda e: F.length(e["key"]) >= e["least"]), lambda e: F.struct(e["text"].alias("text"), e["key"].alias("key"), e["source"].alias("source")))
    return F.aggregate(entries, empty, lambda acc, a: F.when(F.exists(acc, lambda x: x["key"] == a["key"]), acc).otherwise(F.array_append(acc, a)))


def alias_rows(catalog: DataFrame) -> DataFrame:
    """(id, source, text, key) of every admitted alias."""
    # The outer form: the plain one would work out the aliases again for filters on them.
    return catalog.select("id", F.explode_outer("aliases").alias("a")).where("a is not null").select("id", "a.source", "a.text", "a.key")


def build_catalog(raw: DataFrame, column: str = "raw") -> DataFrame:
    """Catalog rows of raw metadata (a VARIANT column); rows without id or name fail."""
    shaped = record(column)
    rows = raw.select(*[c.alias(k) for k, c in shaped.items()])
    aliases = admitted_aliases(F.col("name"), F.col("_raw_title"), F.col("_detailed_title"), F.col("style"), F.col("slug"))
    rows = rows.withColumn("aliases", aliases).drop("_raw_title", "_detailed_title")
    described = T.distinct_text(F.concat(F.array("name", "producer"), F.col("grapes"), F.array("region"), F.col("style")))
    rows = rows.withColumns({"schema_version": F.lit(VERSION), "search_text": F.array_join(described, " | "), "source": F.lit(None).cast("string")})
    require_none(rows.where("id is null or name is null").select("id", "name"), "records without id or name")
    require_none(duplicate_keys(rows, "id"), "duplicate ids")
    return rows


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def catalog_problems(catalog: DataFrame) -> DataFrame:
    """(id, reason) of rows that break the catalog's contract."""
    reason = F.when(~F.col("schema_version").eqNullSafe(F.lit(VERSION)), "schema version").when(F.coalesce(F.trim("id"), F.lit("")) == "", "missing id").when(F.coalesce(F.trim("name"), F.lit("")) == "", "missing name")
    twice = duplicate_keys(catalog.where("id is not null"), "id").select("id", F.lit("duplicate id").alias("reason"))
    return catalog.select("id", reason.alias("reason")).where("reason is not null").union(twice)


def addition_problems(additions: DataFrame, catalog: DataFrame, prefix: str = "manual:") -> DataFrame:
    """(id, reason) of verified additions (id, name, grapes, aliases) to refuse."""
    short = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: (F.length(T.key(a)) < 6) | (F.size(T.tokens(T.key(a))) < 2))
    blank = F.exists(F.coalesce("grapes", F.array().cast("array<string>")), lambda g: g.isNull() | (F.trim(g) == ""))
    good_id = F.col("id").startswith(prefix) & (F.length("id") > len(prefix))
    reason = F.when(~F.coalesce(good_id, F.lit(False)), "id").when(F.coalesce(F.trim("name"), F.lit("")) == "", "name").when(blank, "grapes").when(short, "alias")
    rows = additions.select("id", reason.alias("reason")).where("reason is not null")
    twice = duplicate_keys(additions.select("id").union(catalog.select("id")), "id").join(additions.select("id").distinct(), "id").select("id", F.lit("duplicate id").alias("reason"))
    return rows.union(twice)


def with_additions(catalog: DataFrame, additions: DataFrame) -> DataFrame:
    """Catalog rows followed by verified additions, with an order column."""
    return catalog.withColumn("_part", F.lit(0)).unionByName(additions.withColumn("_part", F.lit(1)), allowMissingColumns=True)


# Merge of a keyed table into a base ------------------------------------------


def merge_conflicts(base: DataFrame, rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys of both tables whose ``columns`` differ."""
    differ = F.lit(False)
    for c in columns:
        differ = differ | ~F.col(f"b.{c}").eqNullSafe(F.col(f"r.{c}"))
    return base.alias("b").join(rows.alias("r"), key).where(differ).select(key, *[F.col(f"b.{c}").alias(f"base_{c}") for c in columns], *[F.col(f"r.{c}").alias(f"new_{c}") for c in columns])


def conflicting_rows(rows: DataFrame, key: str) -> DataFrame:
    """(key, versions) of keys with more than one distinct row."""
    return rows.distinct().groupBy(key).agg(F.count("*").alias("versions")).where("versions > 1")


def new_rows(base: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Distinct rows whose key the base lacks."""
    return rows.distinct().join(base.select(key), key, "left_anti")


def assign_ids(fresh: DataFrame, previous: DataFrame, key: str, start: int) -> DataFrame:
    """``fresh`` with ``assigned_id``: the id of an earlier run for the key, or
    the next free ones in key order."""
    known = fresh.join(previous.select(key, F.col("assigned_id").alias("_old")), key, "left")
    highest = previous.agg(F.max("assigned_id")).first()[0]
    first = max(start, start if highest is None else highest + 1)
    numbered = running(known.where("_old is null").select(key).distinct(), [], [key], _new=F.lit(1))
    numbered = numbered.withColumn("_new", F.col("_new") + first)
    return known.join(numbered, key, "left").withColumn("assigned_id", F.coalesce(F.col("_old").cast("long"), F.col("_new"))).drop("_old", "_new")


def scraped_record(raw: Column | str, position: Column) -> dict[str, Column]:
    """Metadata columns of a scraped item (a VARIANT): the first filled of the
    member names that sources use (``grape`` stays a VARIANT, text or list); the item
    itself stays as ``raw_metadata``."""
    v = F.col(raw) if isinstance(raw, str) else raw

    def first(*names: str) -> Column:
        members = [F.try_variant_get(v, f"$.{n}", "variant") for n in names]
        return F.coalesce(*[F.when(filled(m), m) for m in members])

    def text(*names: str) -> Column:
        return F.try_variant_get(first(*names), "$", "string")

    image = text("image_url", "image", "photo")
    scraped_id = F.coalesce(text("id", "code"), (position + 1).cast("string"))
    suffix = F.coalesce(F.nullif(T.url_suffix(image), F.lit("")), F.lit(".png"))
    return {
        "scraped_id": scraped_id,
        "name": text("name", "title"),
        "producer": text("producer", "winery"),
        "year": text("year", "vintage"),
        "color": text("color"),
        "sugar": text("sugar", "category"),
        "region": text("region"),
        "grape": first("grape", "varieties"),
        "rating": text("rating_roskachestvo", "rating"),
        "remote_image_url": image,
        "local_name": F.when(image.isNotNull(), F.concat(F.lit("wine_"), scraped_id, suffix)),
        "raw_metadata": v,
    }


def csv_record(rows: DataFrame) -> DataFrame:
    """Metadata records of cleaned admin rows (name, category, color, region,
    grapes, description, producer, slug, photo, assigned_id)."""
    grapes = F.filter(F.transform(F.split("grapes", ","), lambda g: F.trim(g)), lambda g: g != "")
    return rows.select(
        F.col("assigned_id").cast("string").alias("scraped_id"), "name", "producer", F.lit(None).cast("string").alias("year"), "color",
        F.col("category").alias("sugar"), "region", grapes.alias("grape"), F.col("photo").alias("remote_image_url"),
        F.struct(F.col("name").alias("title"), F.col("producer").alias("manufacturer"), "region", "category", "slug").alias("raw_metadata"),
        F.struct("slug", "description").alias("detailed_metadata"),
    )


def enrich(candidates: DataFrame, catalog: DataFrame, columns: list[str]) -> DataFrame:
    """Candidates with catalog columns: where both have a name the catalog's
    value wins; candidates the catalog lacks stay as they are (``known`` false)."""
    side = catalog.select("id", *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_known"))
    out = candidates.join(side, "id", "left")
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_known"), F.col(f"_{c}")).otherwise(F.col(c) if c in candidates.columns else F.lit(None))).drop(f"_{c}")
    return out.withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")


def to_enrich(records: DataFrame) -> DataFrame:
    """Records worth a lookup: a slug, and no year or no rating."""
    return records.where("slug is not null and slug <> '' and not (year is not null and rating is not null)")


def alias_sources(catalog: DataFrame) -> DataFrame:
    """(source, n): admitted aliases by where they come from."""
    return alias_rows(catalog).groupBy("source").agg(F.count("*").alias("n"))
