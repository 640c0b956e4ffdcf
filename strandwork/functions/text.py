"""Text functions as column expressions."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Word lists and markers that results depend on.
GENERIC_TOKENS = "inc corp corporation co ltd llc gmbh ag plc sa se nv ab oyj kk ai technologies technology labs holdings group energy".split()
CONTEXT_STOPWORDS = "the a an and or of for with to in on at as by from its their new is are has have will was were this that".split()
TRANSIENT_WORDS = ["timeout", "timed out", "connection", "unavailable", "too many requests", "rate limit", "temporar"]
TRANSIENT_CODES = ["408", "409", "425", "429", "5[0-9][0-9]"]
# End of fixed values.

TRANSIENT = rf"(?i){'|'.join(TRANSIENT_WORDS)}|HTTP ({'|'.join(TRANSIENT_CODES)})"

ELLIPSIS = "…"


def name_key(name: Column) -> Column:
    """Runs of white space as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(name, r"[ \t\n\r\f\x0b]+", " ")))


def tokens(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits, ``&`` read as "and". For text without diacritics; see ``folded``."""
    plain = F.trim(F.regexp_replace(F.replace(F.lower(text), F.lit("&"), F.lit(" and ")), "[^a-z0-9]+", " "))
    return F.filter(F.split(plain, " "), lambda w: w != "")


#: Of so many texts at a time there are copies in Python.
FOLDED_ROWS = 256


def fold(texts: pa.Array) -> pa.Array:
    """``texts`` decomposed, without what is not ASCII."""
    plain = lambda v: None if v is None else unicodedata.normalize("NFKD", v).encode("ascii", "ignore").decode("ascii")
    parts = (texts.slice(at, FOLDED_ROWS).to_pylist() for at in range(0, len(texts), FOLDED_ROWS))
    return pa.concat_arrays([pa.array(map(plain, part), pa.string()) for part in parts] or [pa.array([], pa.string())])


def folded(text: Column) -> Column:
    """Text without diacritics and other marks: compatibility decomposition, ASCII only. Texts that are ASCII stay where
    they are; the others go through Python as Arrow, a few at a time."""
    return F.coalesce(F.arrow_udf(fold, "string")(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def strip_generic(words: Column) -> Column:
    """Drops trailing legal and filler words, but never the first word."""
    last = F.aggregate(
        F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))),
        F.lit(0),
        lambda kept, x: F.when(x["w"].isin(GENERIC_TOKENS), kept).otherwise(x["i"]),
    )
    return F.slice(words, 1, last + 1)


def slug_candidates(names: Column, most: int = 6) -> Column:
    """For each name, its words hyphenated, the same without trailing filler words, and joined; first ones, no repeats."""
    forms = F.transform(
        names,
        lambda n: F.array(F.array_join(tokens(n), "-"), F.array_join(strip_generic(tokens(n)), "-"), F.array_join(tokens(n), "")),
    )
    return F.slice(F.filter(F.array_distinct(F.flatten(forms)), lambda s: F.length(s) >= 2), 1, most)


def context_terms(text: Column) -> Column:
    """Words of three letters or more that say something."""
    return F.array_distinct(F.filter(tokens(text), lambda w: (F.length(w) >= 3) & ~w.isin(CONTEXT_STOPWORDS)))


def context_hits(text: Column, context: Column, own: Column) -> Column:
    """How many context words the text has beyond the name's own."""
    return F.size(F.array_except(F.array_intersect(tokens(text), context), own))


def slug_from_url(url: Column) -> Column:
    """The company slug of a profile URL, decoded; null unless it is plain."""
    slug = F.try_url_decode(F.regexp_extract(url, "/company/([^/?#]+)", 1))
    return F.when(slug.rlike(r"^[A-Za-z0-9][A-Za-z0-9._-]*$"), slug)


def cut(text: Column, most: int) -> Column:
    """At most ``most`` characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit(ELLIPSIS))).otherwise(text)


def first_takeaway(text: Column) -> Column:
    """What follows the label of the first line that has one."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x).rlike(r"(?i)^(direct|market dynamics|indirect):"))
    return F.trim(F.regexp_replace(F.get(lines, F.lit(0)), r"^[^:]*:", ""))


def short_subtitle(text: Column) -> Column:
    """The first takeaway in 120 characters, or nothing."""
    line = first_takeaway(text)
    return F.coalesce(F.when(F.length(line) > 120, F.concat(F.rtrim(F.substring(line, 1, 119)), F.lit(ELLIPSIS))).otherwise(line), F.lit(""))


def render_subtitle(text: Column) -> Column:
    """The first takeaway in 140 characters, or the first line."""
    line = F.coalesce(first_takeaway(text), F.trim(F.get(F.split(text, "\n"), F.lit(0))))
    return F.coalesce(F.when(F.length(line) > 140, F.concat(F.rtrim(F.substring(line, 1, 139)), F.lit(ELLIPSIS))).otherwise(line), F.lit(""))


def short_post(headline: Column, tickers: Column, most: int = 250) -> Column:
    """Headline and up to three cash tags, the headline cut so that all fits."""
    tags = F.array_join(F.transform(F.slice(tickers, 1, 3), lambda x: F.concat(F.lit("$"), x)), " ")
    tail = F.when(tags == "", "").otherwise(F.concat(F.lit(" "), tags))
    room = F.lit(most) - F.length(tail)
    body = F.when(F.length(headline) > room, F.concat(F.substring(headline, F.lit(1), room - 1), F.lit(ELLIPSIS))).otherwise(headline)
    return F.concat(body, tail)


def long_post(*parts: Column) -> Column:
    """Parts with a blank line between them, empty ones left out."""
    return F.array_join(F.filter(F.array(*parts), lambda p: p.isNotNull() & (p != "")), "\n\n")


def label(text: Column) -> Column:
    """``rel_type`` as a title."""
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def document_key(key: Column) -> Column:
    return F.replace(key, F.lit("/"), F.lit("__"))


def typed_value(text: Column) -> Column:
    """Kind of a value given as text: null, bool, int, float or str."""
    return (
        F.when(F.lower(text).isin("null", ""), "null")
        .when(F.lower(text).isin("true", "false"), "bool")
        .when(text.rlike(r"^[+-]?[0-9]{1,18}$"), "int")
        .when(text.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"), "float")
        .otherwise("str")
    )


def html_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


_NOT_TEXT = r"(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<head[^>]*>.*?</head>|<nav[^>]*>.*?</nav>"


def html_text(html: Column) -> Column:
    """What a page says: without comments, scripts, styles, head and navigation, tags as spaces."""
    bare = F.regexp_replace(F.regexp_replace(html, _NOT_TEXT, " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(bare, r"[ \t\r\n]+", " "))


def png_size(content: Column, which: int) -> Column:
    """Width (0) or height (1) in a PNG's header."""
    return F.conv(F.hex(F.substring(content, 17 + 4 * which, 4)), 16, 10).cast("long")


def is_transient(error: Column) -> Column:
    """Whether an error is worth another attempt."""
    return error.rlike(TRANSIENT)


def search_results(answers: DataFrame) -> DataFrame:
    """``provider`` and JSON ``body`` of four services as title, link and snippet, one row each."""
    plain = "array<struct<title: string, link: string, snippet: string>>"
    other = "array<struct<title: string, url: string, description: string>>"
    body = F.from_json("body", f"struct<web: struct<results: {other}>, organic: {plain}, organic_results: {plain}, items: {plain}>")
    first = F.transform(F.col("_b.web.results"), lambda r: F.struct(r["title"].alias("title"), r["url"].alias("link"), r["description"].alias("snippet")))
    rows = F.coalesce(first, F.col("_b.organic"), F.col("_b.organic_results"), F.col("_b.items"))
    return answers.withColumn("_b", body).withColumn("_r", F.explode(rows)).select(*[c for c in answers.columns if c != "body"], "_r.title", "_r.link", "_r.snippet")
