"""String functions on event titles, names, keys and URLs."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Characters that have no width.
INVISIBLE = "[­​‌‍⁠﻿]"

#: Words that don't count in a title when events of several sources are compared.
DEDUP_STOPWORDS = [
    "der", "die", "das", "den", "dem", "und", "oder", "mit", "im", "in", "ein",
    "eine", "einen", "einem", "auf", "an", "am", "von", "vom", "zur", "zum",
    "bei", "für", "fuer", "&", "-", "–", "—", "presents",
]

#: Words that don't count in a title when performances are grouped.
GROUP_STOPWORDS = [
    "der", "die", "das", "den", "dem", "und", "oder", "mit", "im", "in",
    "ein", "eine", "einen", "einem", "auf", "an", "am", "von", "vom",
    "zur", "zum", "bei", "für", "fuer", "&", "-",
]

#: The longest string that each field holds.
FIELD_LIMITS = {
    "canonical_id": 100, "title": 500, "category": 100, "source_name": 255, "source_url": 500, "venue_name": 255, "address_text": 500,
    "city": 100, "age_note": 255, "price_text": 255, "weather_note": 255, "image_url": 500, "sources_list": 500,
}

#: A date header of a listing page that got into a title.
BROKEN_TITLE = (
    r"(?iu)(?:^|TAGESTIPP|PRÄSENTIERT|VERLOSUNG)\s*[0-9]{0,4}\s*"
    r"(?:Mo|Di|Mi|Do|Fr|Sa|So|Heute|Morgen|Übermorgen)[,\s]\s*[0-9]{1,2}\.\s*"
    r"(?:Jan|Feb|Mär|Apr|Mai|Jun|Jul|Aug|Sep|Okt|Nov|Dez)[\p{L}\p{N}_]*\s*\|\s*[0-9]{1,2}:[0-9]{2}"
)


def truthy(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


@pandas_udf(StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(c: Column) -> Column:
    """Unicode form NFKC; Python sees only strings that hold non-ASCII characters."""
    return F.when(c.rlike(r"[^\x00-\x7f]"), _nfkc(F.when(c.rlike(r"[^\x00-\x7f]"), c))).otherwise(c)


def sanitize_title(c: Column) -> Column:
    """Without invisible characters and repeated white space; null if nothing is left."""
    out = F.trim(F.regexp_replace(F.regexp_replace(c, INVISIBLE, ""), r"(?U)\s+", " "))
    return F.when(out != "", out)


def normalise_title(c: Column, stopwords: list[str], unicode_form: bool = False) -> Column:
    """Lower-case words of letters, digits and underscores without stopwords, by single spaces; '' for null."""
    s = F.regexp_replace(F.coalesce(c, F.lit("")), INVISIBLE, "")
    s = F.lower(nfkc(s) if unicode_form else s)
    words = F.split(F.regexp_replace(s, r"[^\p{L}\p{N}_ ]+", " "), " +")
    return F.array_join(F.filter(words, lambda w: (w != "") & ~w.isin(stopwords)), " ")


def dedup_title(c: Column, unicode_form: bool = False) -> Column:
    return normalise_title(c, DEDUP_STOPWORDS, unicode_form)


def group_title(c: Column, unicode_form: bool = False) -> Column:
    return normalise_title(c, GROUP_STOPWORDS, unicode_form)


def title_tokens(c: Column, unicode_form: bool = False) -> Column:
    """The distinct words of a normalised title."""
    return F.array_distinct(F.filter(F.split(dedup_title(c, unicode_form), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two arrays of distinct words; 0 if one is empty."""
    both = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def clamp(c: Column, limit: int) -> Column:
    """Cut to ``limit`` characters and trailing white space, if it is longer."""
    return F.when(F.length(c) > limit, F.regexp_replace(F.substring(c, 1, limit), r"(?U)\s+$", "")).otherwise(c)


def clamp_fields(df):
    """All string fields within their limits."""
    return df.withColumns({c: clamp(F.col(c), n) for c, n in FIELD_LIMITS.items() if c in df.columns})


def is_broken_title(c: Column) -> Column:
    return F.coalesce(c.rlike(BROKEN_TITLE), F.lit(False))


def cache_key(c: Column) -> Column:
    """Trimmed, lower-case, single spaces, 500 characters."""
    return F.substring(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", " ")), 1, 500)


def geocode_query(venue: Column, address: Column, city: Column, default_city: str) -> Column:
    """``venue|address|city`` without bars at the ends."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    named = F.when(truthy(city), city).otherwise(default_city)
    return F.btrim(F.concat_ws("|", empty(venue), empty(address), named), F.lit("|"))


def canonical_id(key: Column) -> Column:
    """The first 16 hex digits of the MD5 of a source's own key."""
    return F.substring(F.md5(key), 1, 16)


def csv_list(c: Column) -> Column:
    """Trimmed parts of a comma-separated list, without empty ones."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def capitalise(c: Column) -> Column:
    """First letter upper, the rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 20)))


def absolute_url(c: Column, base: str) -> Column:
    """A link with the site put before it where it starts with a slash or has no scheme."""
    site = base.rstrip("/")
    return (
        F.when(~truthy(c), None)
        .when(c.startswith("http"), c)
        .when(c.startswith("//"), F.concat(F.lit("https:"), c))
        .when(c.startswith("/"), F.concat(F.lit(site), c))
        .otherwise(F.concat(F.lit(site + "/"), c))
    )


def robots_url(c: Column) -> Column:
    """``scheme://host/robots.txt`` of a URL."""
    return F.concat(F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1), F.lit("/robots.txt"))


def js_unescape(c: Column) -> Column:
    """Quotes, slashes, line breaks and tabs of a JavaScript string; a line break becomes a space."""
    out = c
    for written, meant in ((r"\"", '"'), (r"\'", "'"), (r"\`", "`"), (r"\n", " "), (r"\r", ""), (r"\t", " "), (r"\/", "/"), ("\\\\", "\\")):
        out = F.replace(out, F.lit(written), F.lit(meant))
    return out


def clean_listing_title(c: Column) -> Column:
    """A title without date headers in front, a second date behind, price and label tails; '' if over 180 characters."""
    day = r"(?:TAGESTIPP|PRÄSENTIERT|VERLOSUNG)?\s*[0-9]{0,4}\s*(?:Mo|Di|Mi|Do|Fr|Sa|So|Heute|Morgen|Übermorgen)[,\s]\s*[0-9]{1,2}\.\s*[\p{L}]+\.?\s*(?:\|\s*[0-9]{1,2}:[0-9]{2})?(?:\s*Uhr)?\s*"
    out = F.trim(F.coalesce(c, F.lit("")))
    for _ in range(3):
        out = F.regexp_replace(out, "(?iu)^" + day, "")
    out = F.regexp_replace(out, "(?iu)\\s*(?:Mo|Di|Mi|Do|Fr|Sa|So),\\s*[0-9]{1,2}\\.\\s*[\\p{L}]+.*$", "")
    out = F.regexp_replace(out, r"(?iu)\s*(?:ab\s*)?[0-9]+(?:[.,][0-9]{2})?\s*€.*$", "")
    out = F.trim(F.regexp_replace(out, r"(?iu)\s*(?:TAGESTIPP|PRÄSENTIERT|VERLOSUNG)\s*$", ""))
    return F.when(F.length(out) > 180, "").otherwise(out)
