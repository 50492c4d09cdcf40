"""Inverted indexes of a catalog, as long tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lexbind.functions import text as T

#: Fields in evidence order; the first three retrieve candidates.
FIELDS = ("name", "producer", "grapes", "region", "style")
IDENTIFYING = FIELDS[:3]
#: Least rarity that any word counts with.
MIN_SPECIFICITY = 0.35
MICRO = 1_000_000


def field_forms(catalog: DataFrame, exact: bool = False) -> DataFrame:
    """(id, field, field_pos, form_pos, form): distinct search forms of each
    field in order.  Aliases, if any, stand for the name.  ``exact`` uses the
    Arrow normaliser, for text that may not be composed."""
    aliases = F.transform(F.coalesce("aliases", F.array().cast("array<struct<text:string,key:string,source:string>>")), lambda a: a["text"])
    values = {
        "name": F.when(F.size(aliases) > 0, aliases).otherwise(F.array("name")),
        "producer": F.array("producer"),
        "grapes": F.coalesce("grapes", F.array().cast("array<string>")),
        "region": F.array("region"),
        "style": F.coalesce("style", F.array().cast("array<string>")),
    }
    if exact:
        return _exact_forms(catalog.select("id", *[v.alias(f) for f, v in values.items()]))
    fields = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("field_pos"), F.array_distinct(F.flatten(F.transform(values[f], lambda v: T.forms(v)))).alias("forms")) for k, f in enumerate(FIELDS)])
    rows = catalog.select("id", F.explode(fields).alias("f"))
    return rows.select("id", "f.field", "f.field_pos", F.posexplode("f.forms").alias("form_pos", "form"))


def _exact_forms(values: DataFrame) -> DataFrame:
    """:func:`field_forms` of (id, one array a field) by the Arrow normaliser."""
    named = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("field_pos"), F.col(f).alias("v")) for k, f in enumerate(FIELDS)])
    rows = values.select("id", F.explode(named).alias("f")).select("id", "f.field", "f.field_pos", F.posexplode("f.v").alias("at", "value"))
    rows = rows.withColumn("_f", T.exact_forms("value")).select("id", "field", "field_pos", F.posexplode(F.array("_f.key", "_f.accent")).alias("sub", "form"), "at").where("form <> ''")
    firsts = rows.groupBy("id", "field", "field_pos", "form").agg(F.min(F.struct("at", "sub")).alias("first"))
    place = F.row_number().over(Window.partitionBy("id", "field").orderBy("first")) - 1
    return firsts.select("id", "field", "field_pos", place.alias("form_pos"), "form")


def token_postings(forms: DataFrame) -> DataFrame:
    """Distinct (token, id) of the identifying fields."""
    words = forms.where(F.col("field").isin(*IDENTIFYING)).select("id", F.explode(T.tokens("form")).alias("token"))
    return words.where(T.is_indexable(F.col("token"))).select("token", "id").distinct()


def gram_postings(forms: DataFrame) -> DataFrame:
    """Distinct (gram, id) of the identifying fields."""
    return forms.where(F.col("field").isin(*IDENTIFYING)).select("id", F.explode(T.trigrams("form")).alias("gram")).select("gram", "id").distinct()


def frequencies(postings: DataFrame) -> DataFrame:
    """(term, df): products that hold each term."""
    term = postings.columns[0]
    return postings.groupBy(term).agg(F.count("*").alias("df"))


def weight(n: Column, df: Column) -> Column:
    """Vote of a term: the rarer, the more."""
    return F.log1p(n / (1 + df))


def micro(c: Column) -> Column:
    """A weight in whole millionths, so that sums do not depend on order."""
    return F.round(c * MICRO).cast("long")


def alias_owners(forms: DataFrame) -> DataFrame:
    """(form, owners, owner): products with a name form; the only one, if one."""
    return forms.where("field = 'name'").groupBy("form").agg(F.count_distinct("id").alias("owners"), F.min("id").alias("owner"))


def specificity(keys: DataFrame, token_df: DataFrame, n: int) -> DataFrame:
    """(key, specificity): the rarest known eligible word's rarity, at least the floor."""
    words = keys.select("key").distinct().select("key", F.explode_outer(T.tokens("key")).alias("token"))
    known = words.join(token_df, "token", "left")
    value = F.when(T.is_indexable(F.col("token")) & F.col("df").isNotNull(), F.log1p(F.lit(float(n)) / (1 + F.col("df"))) / F.log1p(F.lit(float(max(n, 1)))))
    return known.groupBy("key").agg(F.greatest(F.lit(MIN_SPECIFICITY), F.coalesce(F.max(value), F.lit(MIN_SPECIFICITY))).alias("specificity"))
