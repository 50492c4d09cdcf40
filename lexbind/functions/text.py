"""Text normalisation as Column expressions.

The native forms equal the exact ones on text that is already composed (NFC)
and compatibility-stable; :func:`exact_forms` handles any Unicode text in one
Arrow UDF.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Base letters that do not decompose (fixed values).
UNDECOMPOSED = {"æ": "ae", "œ": "oe", "ø": "o", "ł": "l", "đ": "d", "ð": "d", "þ": "th"}
#: Latin letters with marks and what remains without them, for the native
#: approximation; built from the character database, not listed.
_MARKED = {c: unicodedata.normalize("NFD", c)[0] for c in map(chr, range(0xC0, 0x250)) if c.islower() and len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isascii()}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White-space runs (any Unicode space) to one space, trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def display(c: Column | str) -> Column:
    """Printable text: control and format characters to spaces, spaces collapsed; null to empty."""
    return F.coalesce(collapse(F.regexp_replace(_col(c), r"\p{C}", " ")), F.lit(""))


def key(c: Column | str) -> Column:
    """Search key: case-folded, everything but letters and digits to single spaces."""
    # Spaces need no pass of their own: the last step collapses all that is no word.
    plain = F.coalesce(F.regexp_replace(_col(c), r"\p{C}", " "), F.lit(""))
    folded = F.replace(F.replace(F.lower(plain), F.lit("ß"), F.lit("ss")), F.lit("ё"), F.lit("е"))
    return F.trim(F.regexp_replace(folded, r"[^\p{L}\p{N}]+", " "))


def accentless(k: Column | str) -> Column:
    """A key without the marks of Latin letters (native: Latin up to Extended-B)."""
    out = F.translate(_col(k), "".join(_MARKED), "".join(_MARKED.values()))
    return reduce(lambda c, kv: F.replace(c, F.lit(kv[0]), F.lit(kv[1])), UNDECOMPOSED.items(), out)


def forms(c: Column | str) -> Column:
    """[key] or [key, key without marks], empties dropped, in that order."""
    k = key(c)
    plain = accentless(k)
    # No function over arrays: inside one, Spark would work the key out twice.
    return F.when(k == "", F.array().cast("array<string>")).when(k == plain, F.array(k)).otherwise(F.array(k, plain))


def tokens(k: Column | str) -> Column:
    """Words of a key; none for an empty key."""
    return F.filter(F.split(_col(k), " "), lambda w: w != "")


def is_indexable(word: Column) -> Column:
    """Long enough to retrieve by, and with a letter."""
    return (F.length(word) >= 3) & word.rlike(r"\p{L}")


def trigrams(k: Column | str) -> Column:
    """Distinct character trigrams of the words of at least four characters with a letter."""
    words = F.filter(tokens(k), lambda w: (F.length(w) >= 4) & w.rlike(r"\p{L}"))
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def script(c: Column | str) -> Column:
    """mixed, latin, cyrillic, numeric or other, by Unicode script."""
    t = _col(c)
    latin, cyrillic = t.rlike(r"\p{IsLatin}"), t.rlike(r"\p{IsCyrillic}")
    return F.when(latin & cyrillic, "mixed").when(latin, "latin").when(cyrillic, "cyrillic").when(t.rlike(r"\p{Nd}"), "numeric").otherwise("other")


def lexicon_script(c: Column | str) -> Column:
    """The same classes by code-point ranges, as the lexicon pools use them."""
    t = _col(c)
    latin, cyrillic = t.rlike(r"[A-Za-zÀ-ɏ]"), t.rlike(r"[Ѐ-ԯ]")
    return F.when(latin & cyrillic, "mixed").when(latin, "latin").when(cyrillic, "cyrillic").when(t.rlike(r"\p{Nd}"), "numeric").otherwise("other")


#: Punctuation that lexicon phrases keep (fixed values).
LEXICON_MARKS = ".,'’&+%°/:-()№"


def lexicon_clean(c: Column | str) -> Column:
    """A phrase for the lexicon: control characters to spaces, long dashes and
    back ticks unified, other marks to spaces, unbalanced parentheses removed,
    outer marks off; null to empty."""
    t = F.translate(F.regexp_replace(_col(c), r"[\x00-\x1F\x7F\x{A0}]", " "), "–—−`", "---'")
    t = F.regexp_replace(t, r"[^\p{L}\p{N}\s\Q" + LEXICON_MARKS + r"\E]", " ")
    opened = F.length(t) - F.length(F.replace(t, F.lit("("), F.lit("")))
    closed = F.length(t) - F.length(F.replace(t, F.lit(")"), F.lit("")))
    t = F.when(opened == closed, t).otherwise(F.regexp_replace(t, r"[()]", " "))
    return F.coalesce(F.btrim(collapse(t), F.lit(" .,:;-/")), F.lit(""))


def vocabulary_clean(c: Column | str) -> Column:
    """Letters, digits, underscores, spaces and ``- . %`` only; null to empty."""
    return F.coalesce(collapse(F.regexp_replace(_col(c), r"(?U)[^\w\s\-.%]", "")), F.lit(""))


def is_usable(c: Column | str, least: int = 2) -> Column:
    """Worth keeping as a phrase: long enough, no address, few slashes, a letter or digit."""
    t = _col(c)
    slashes = F.length(t) - F.length(F.replace(t, F.lit("/"), F.lit("")))
    return (F.length(t) >= least) & ~t.rlike(r"(?i)https?:|www\.") & ~t.contains("\\") & (slashes <= 2) & t.rlike(r"[\p{L}\p{N}]")


def chunk_phrase(c: Column | str, most: int) -> Column:
    """A cleaned phrase as it is if short enough, else its cleaned segments, long
    ones packed word by word into chunks of at most ``most`` characters, as far
    as they are usable; over-long words are dropped and end the current chunk."""
    t = lexicon_clean(c)
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"))

    def flushed(acc: Column) -> Column:
        return F.when(acc["cur"] != "", F.array_append(acc["done"], acc["cur"])).otherwise(acc["done"])

    def step(acc: Column, w: Column) -> Column:
        longer = F.when(acc["cur"] == "", w).otherwise(F.concat(acc["cur"], F.lit(" "), w))
        return (
            F.when(F.length(w) > most, F.struct(flushed(acc).alias("done"), F.lit("").alias("cur")))
            .when(F.length(longer) <= most, F.struct(acc["done"].alias("done"), longer.alias("cur")))
            .otherwise(F.struct(flushed(acc).alias("done"), w.alias("cur")))
        )

    segments = F.transform(F.split(t, r"[,;|]|\s+[/\-]\s+"), lambda s: tokens(lexicon_clean(s)))
    packed = F.filter(F.flatten(F.transform(segments, lambda ws: F.aggregate(ws, start, step, flushed))), lambda p: is_usable(p))
    return F.when(t == "", F.array().cast("array<string>")).when(F.length(t) <= most, F.array(t)).otherwise(packed)


def strip_suffix(c: Column | str, suffixes: list[str]) -> Column:
    """The cleaned text without the first of the suffixes, longest first, that
    ends it, ignoring case, with a mark and spaces before it if there are any;
    something must remain."""
    t = lexicon_clean(c)
    out = F.lit(None).cast("string")
    for s in sorted(suffixes, key=lambda s: (-len(s), s)):
        ending = lexicon_clean(F.lit(s))
        pattern = F.concat(F.lit(r"(?ius)^(.+?)[,.\-]?\s*\Q"), ending, F.lit(r"\E$"))
        rest = F.nullif(F.call_function("regexp_extract", t, pattern, F.lit(1)), F.lit(""))
        out = F.coalesce(out, F.when(ending != "", F.btrim(rest, F.lit(" ,.-"))))
    return F.coalesce(out, t)


def without_style(name: Column | str, styles: Column | str) -> Column:
    """The name without a style that ends it (by key): the longest key first, the
    first that leaves enough; null if none does."""
    words = tokens(collapse(_col(name)))
    ordered = F.array_sort(F.transform(_col(styles), lambda s, i: F.struct((-F.length(key(s))).alias("n"), i.alias("i"), s.alias("s"))))
    ending = F.filter(ordered, lambda x: (x["n"] < 0) & F.endswith(key(name), F.concat(F.lit(" "), key(x["s"]))))

    def left(x: Column) -> Column:
        rest = F.slice(words, F.lit(1), F.greatest(F.size(words) - F.size(tokens(collapse(x["s"]))), F.lit(0)))
        return F.rtrim(F.array_join(rest, " "), F.lit(" ,.;-–—"))

    return F.try_element_at(F.filter(F.transform(ending, left), lambda r: F.length(key(r)) >= 4), F.lit(1))


def name_from_slug(c: Column | str) -> Column:
    """Words of a slug (outer slashes do not count), or null if it is no plain
    slug or says too little."""
    t = F.btrim(display(c), F.lit("/ "))
    words = F.translate(t, "_-", "  ")
    good = t.rlike(r"^[A-Za-z0-9_\-]+$") & (F.length(key(words)) >= 6) & (F.size(tokens(collapse(words))) >= 2)
    return F.when(good, words)


def nested_name(variant: Column | str) -> Column:
    """The ``name`` of an object, or the scalar itself, of a VARIANT."""
    v = _col(variant)
    return F.coalesce(F.try_variant_get(v, "$.name", "string"), F.try_variant_get(v, "$", "string"))


def distinct_text(values: Column | str) -> Column:
    """Array without values whose key came before; the first spelling stays."""
    # Each value's key is made once; the fold only compares keys.
    keyed = F.filter(F.transform(_col(values), lambda v: F.struct(key(v).alias("key"), display(v).alias("text"))), lambda x: x["key"] != "")
    start = F.struct(F.array().cast("array<string>").alias("keys"), F.array().cast("array<string>").alias("texts"))
    return F.aggregate(
        keyed,
        start,
        lambda acc, x: F.when(F.array_contains(acc["keys"], x["key"]), acc).otherwise(F.struct(F.array_append(acc["keys"], x["key"]).alias("keys"), F.array_append(acc["texts"], x["text"]).alias("texts"))),
        lambda acc: acc["texts"],
    )


def duplicate_key(c: Column | str) -> Column:
    """Letters and digits only, case-folded."""
    return F.regexp_replace(F.replace(F.lower(_col(c)), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def collapse_repeats(c: Column | str) -> Column:
    """Drop words whose duplicate key equals that of the word kept before."""
    text = collapse(c)
    words = tokens(text)
    # The keys of all words at once: one pass over the text, spaces kept.
    keys = F.split(F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N} ]", ""), " ")
    # The word kept last has the key of the word before, kept or not.
    rows = F.arrays_zip(words.alias("w"), keys.alias("k"), F.concat(F.array(F.lit(None).cast("string")), keys).alias("p"))
    kept = F.filter(rows, lambda x: x["w"].isNotNull() & ((x["k"] == "") | ~x["k"].eqNullSafe(x["p"])))
    return F.array_join(F.transform(kept, lambda x: x["w"]), " ")


def allowed_script(c: Column | str, multilingual: bool = True) -> Column:
    """Only ASCII, punctuation, separators, marks, Latin (and Cyrillic) characters."""
    return ~_col(c).rlike(r"[^\x00-\x7F\p{P}\p{Z}\p{M}\p{IsLatin}" + (r"\p{IsCyrillic}" if multilingual else "") + "]")


def alnum_ratio(c: Column | str) -> Column:
    """Share of letters and digits among non-space characters."""
    t = F.regexp_replace(_col(c), r"(?U)\s", "")
    return F.length(F.regexp_replace(t, r"[^\p{L}\p{N}]", "")) / F.greatest(F.length(t), F.lit(1))


def has_run(c: Column | str) -> Column:
    """Four or more equal characters in a row, ignoring case."""
    return F.lower(_col(c)).rlike(r"(?s)(.)\1{3}")


def plausible(c: Column | str, multilingual: bool = True) -> Column:
    """Whether a reading looks like text."""
    t = F.trim(_col(c))
    return (F.length(t) >= 2) & (t != "100") & allowed_script(t, multilingual) & (alnum_ratio(t) >= 0.60) & ~has_run(t)


def years(c: Column | str) -> Column:
    """Four-digit years 19xx and 20xx that stand alone."""
    return F.regexp_extract_all(_col(c), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1))


def catalog_year(c: Column | str) -> Column:
    """The year of a field that is nothing else, or null."""
    t = _col(c).cast("string")
    return F.when(t.rlike(r"^(19|20)\d{2}$") & t.try_cast("int").between(1900, 2100), t.try_cast("int"))


def safe_name(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"[^\p{L}\p{N}\-_]", "_")


def upper_variants(c: Column | str, most: int) -> Column:
    """The phrase and, if different and short enough, its upper-case form."""
    t = _col(c)
    return F.array_distinct(F.filter(F.array(t, F.upper(t)), lambda x: F.length(x) <= most))


def alcohol_text(value: Column | str) -> Column:
    """``12.5% vol`` for numbers strictly between 0 and 30, else null."""
    v = _col(value).cast("double")
    short = F.regexp_replace(F.format_string("%.6f", v), r"\.?0+$", "")
    return F.when((v > 0) & (v < 30), F.concat(short, F.lit("% vol")))


def extended_latin(c: Column | str) -> Column:
    """Whether any letter is outside ASCII."""
    return _col(c).rlike(r"[\p{L}&&[^\x00-\x7F]]")


def url_path(c: Column | str) -> Column:
    """Path of an address without leading slashes and query."""
    t = F.regexp_replace(_col(c), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", "")
    return F.regexp_replace(F.regexp_replace(t, r"[?#].*$", ""), r"^/+", "")


def url_suffix(c: Column | str) -> Column:
    """File suffix of an address, with its dot, lower-case; empty if none."""
    return F.lower(F.regexp_extract(url_path(c), r"(\.[A-Za-z0-9]+)$", 1))


def join_url(base: str, c: Column | str) -> Column:
    """An address relative to a site's root."""
    t = _col(c)
    return F.when(t.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), t).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(t, r"^/+", "")))


# Exact forms ------------------------------------------------------------------

#: Letters and numbers; marks that stand apart are no part of a word.
_WORDS = regex.compile(r"[\p{L}\p{N}]+")
#: Marks that stand on a Latin letter.
_LATIN_MARKS = regex.compile(r"(?<=\p{Latin}\p{M}*)\p{M}")


def display_text(value: str | None) -> str:
    """Exact printable text of any Unicode string."""
    return " ".join(regex.sub(r"\p{C}", " ", unicodedata.normalize("NFC", value or "")).split())


def exact_key(value: str | None) -> str:
    """Exact search key: the words of the folded text."""
    return " ".join(_WORDS.findall(unicodedata.normalize("NFKC", display_text(value)).casefold().replace("ё", "е")))


def exact_accentless(k: str) -> str:
    """A key without the marks that stand on Latin letters."""
    apart = unicodedata.normalize("NFKD", k.translate(str.maketrans(UNDECOMPOSED)))
    return exact_key(unicodedata.normalize("NFC", _LATIN_MARKS.sub("", apart)))


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("display", "key", "accent")]))
def exact_forms(values: pd.Series) -> pd.DataFrame:
    """Display text, key and accentless key of any text."""
    keys = [exact_key(v) for v in values]
    return pd.DataFrame({"display": [display_text(v) for v in values], "key": keys, "accent": [exact_accentless(k) for k in keys]})
