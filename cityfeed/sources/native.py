"""Payloads that Spark reads itself: API answers, the data of a page, feeds.

``read`` takes those whose shape is the plain one, field by field of the types
that the source's contract names, as VARIANT or by ``from_xml``; it marks the
others, and the parsers of ``parsers`` take these. So a payload gives the same
events whichever way it goes, and the usual one needs no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cityfeed.functions.dates import MONTHS, ZONE, make_timestamp, month_number
from cityfeed.sources.tables import dealt

#: An ISO time that both ways read alike.
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:\d{2})?)?$"
#: ``7. Juli 2026, 18:30``, with or without the year and the time.
TERM = rf"^(\d{{1,2}})\. ({'|'.join(sorted(MONTHS, key=len, reverse=True))})(?: (\d{{4}}))?(?:,? (\d{{1,2}}):(\d{{2}}))?$"

#: White space beyond that of ASCII, as part of a set; Python counts it as such, Spark doesn't.
ODD_SPACE = r"\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _text(item: Column, path: str) -> Column:
    """The string at a path, else null."""
    return F.try_variant_get(item, path, "string")


def _kind(item: Column, path: str) -> Column:
    """STRING, OBJECT, ARRAY and so on; null where there is nothing."""
    found = F.try_variant_get(item, path, "variant")
    kind = F.regexp_extract(F.schema_of_variant(found), r"^[A-Z]+", 0)
    return F.when(found.isNotNull() & ~F.is_variant_null(found), kind)


def _is(item: Column, path: str, *kinds: str) -> Column:
    return F.coalesce(_kind(item, path).isin(*kinds), F.lit(True))


def _filled(c: Column) -> Column:
    return F.when(c != "", c)


def _iso(text: Column) -> Column:
    """Wall-clock time in Berlin; without an offset the time as it is."""
    zoned = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.to_utc_timestamp(F.try_to_timestamp(text), F.current_timezone()).cast("timestamp_ntz"))
    return F.when(text.rlike(r"(Z|[+-]\d{2}:\d{2})$"), zoned).otherwise(text.try_cast("timestamp_ntz"))


def _absolute(link: Column, base: str) -> Column:
    joined = F.when(link.startswith("//"), F.concat(F.lit("https:"), link)).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.ltrim(link, F.lit("/"))))
    return F.when(link == "", None).when(link.startswith("http"), link).otherwise(joined)


def _event(key: Column, title: Column, **fields) -> Column:
    """Struct of an event's fields; the id comes from the source's own key."""
    from cityfeed.sources.parsers import DESCRIPTION, FIELDS

    known = {"canonical_id": F.substring(F.md5(key), 1, 16), "title": title, "is_permanent_offer": F.lit(False)} | fields
    if "short_description" in known:
        known["short_description"] = F.substring(known["short_description"], 1, DESCRIPTION)
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(*[lit(known.get(f.name)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(FIELDS)])


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of ``value``, which is worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _zollverein(payload: Column, now: datetime) -> tuple[Column, Column]:
    read = _once(F.try_parse_json(payload), lambda v: F.struct(*[c.alias(n) for c, n in zip(_answer(v), ("plain", "found"), strict=True)]))
    return read["plain"], read["found"]


def _answer(v: Column) -> tuple[Column, Column]:
    """Whether an API answer is plain, and its events."""
    wrapped = F.coalesce(*[F.when(_kind(v, f"$.{k}") == "ARRAY", F.try_variant_get(v, f"$.{k}", "array<variant>")) for k in ("events", "data", "results")], F.array().cast("array<variant>"))
    items = F.when(_kind(v, "$") == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(wrapped)
    items = F.filter(items, lambda x: F.coalesce(_kind(x, "$") == "OBJECT", F.lit(False)))
    start = lambda x: F.coalesce(*[_filled(_text(x, f"$.{k}")) for k in ("startDate", "start_date", "start")])
    named = ("title", "name", "url", "link", "description", "startDate", "start_date", "start")

    def regular(x: Column) -> Column:
        strings = F.lit(True)
        for k in named:
            strings &= _is(x, f"$.{k}", "STRING")
        place = _is(x, "$.location", "STRING", "OBJECT") & _is(x, "$.location.name", "STRING")
        return strings & place & _is(x, "$.category", "STRING", "ARRAY") & _is(x, "$.category[0]", "STRING") & F.coalesce(start(x).rlike(ISO), F.lit(True))

    def event(x: Column) -> Column:
        title, link = F.coalesce(_filled(_text(x, "$.title")), _text(x, "$.name")), F.coalesce(_filled(_text(x, "$.url")), _text(x, "$.link"), F.lit(""))
        where = F.when(_kind(x, "$.location") == "OBJECT", _text(x, "$.location.name")).otherwise(_text(x, "$.location"))
        kind = F.when(_kind(x, "$.category") == "ARRAY", _text(x, "$.category[0]")).otherwise(_text(x, "$.category"))
        return _event(
            F.coalesce(_filled(link), title), title, short_description=F.coalesce(_text(x, "$.description"), F.lit("")), start_at=_iso(start(x)), category=kind, source_name="Zollverein", source_url=_absolute(link, "https://www.zollverein.de"),
            venue_name=F.coalesce(_filled(where), F.lit("Zollverein")), city="Essen", lat=51.4864, lon=7.0403, indoor_outdoor="both",
        )

    events = F.filter(F.transform(items, event), lambda e: F.coalesce(e["title"] != "", F.lit(False)))
    return v.isNotNull() & _kind(v, "$").isin("ARRAY", "OBJECT") & F.forall(items, regular), events


def _villa_huegel(payload: Column, now: datetime) -> tuple[Column, Column]:
    held = F.regexp_extract(payload, r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1)
    words = lambda x, k: F.trim(F.regexp_replace(F.coalesce(_text(x, f"$.{k}"), F.lit("")), r"[ \t\n\x0b\f\r]+", " "))

    def items(v: Column) -> Column:
        found = F.when(_kind(v, "$") == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.try_variant_get(v, "$.props.pageProps.programs", "array<variant>"))
        return F.filter(found, lambda x: F.coalesce(_kind(x, "$") == "OBJECT", F.lit(False)))

    def told(x: Column) -> Column:
        strings = _is(x, "$.id", "STRING", "BIGINT") & _kind(x, "$.id").isNotNull() & _is(x, "$.slug", "STRING") & _kind(x, "$.slug").isNotNull() & _is(x, "$.thumbnail", "OBJECT") & _is(x, "$.thumbnail.src", "STRING")
        for k in ("title", "subtitle", "date_as_string"):
            strings &= _is(x, f"$.{k}", "STRING") & ~F.coalesce(_text(x, f"$.{k}"), F.lit("")).rlike(f"[{ODD_SPACE}]")
        own = [_text(x, f"$.{k}").alias(n) for k, n in (("id", "id"), ("slug", "slug"), ("thumbnail.src", "image"))]
        return F.struct(strings.alias("strings"), words(x, "title").alias("title"), words(x, "subtitle").alias("about"), words(x, "date_as_string").alias("term"), F.lower(words(x, "date_as_string")).alias("low"), *own)

    def dated(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x["low"], TERM, k)
        number = lambda k, other: F.coalesce(_filled(part(k)).cast("int"), F.lit(other))
        over, standing = x["low"].contains("abgeschlossen"), x["term"].rlike(r"(?iu)ganzjährig|jeden|täglich|dauer|laufend|regelmäßig")
        start = F.when(~standing, make_timestamp(number(3, now.year), month_number(part(2)), number(1, 0), number(4, 0), number(5, 0)))
        regular = x["strings"] & (over | standing | (x["term"] == "") | x["low"].rlike(TERM))
        return F.struct(x.alias("x"), regular.alias("regular"), over.alias("over"), start.alias("start"))

    def event(y: Column) -> Column:
        x, start = y["x"], y["start"]
        title, about, term = x["title"], x["about"], x["term"]
        described = F.array_join(F.filter(F.array(about, F.when(term != "", F.concat(F.lit("Termin: "), term)).otherwise("")), lambda t: t != ""), " | ")
        return _event(
            F.concat(F.lit("villa-huegel-"), x["id"]), title, short_description=described, start_at=start, is_permanent_offer=start.isNull(), source_name="Villa Hügel",
            kids_suitable=F.when(F.concat(title, F.lit(" "), about).rlike("(?iu)kinder|family|famil"), "yes").otherwise("unknown"), source_url=F.concat(F.lit("https://www.krupp-stiftung.de/programm/"), x["slug"], F.lit("/")),
            image_url=_filled(x["image"]), venue_name="Villa Hügel", address_text="Hügel 1, 45133 Essen", city="Essen", lat=51.4069, lon=7.0090, indoor_outdoor=F.when(F.lower(about).contains("park"), "both").otherwise("indoor"),
        )

    def both(ys: Column) -> Column:
        kept = F.filter(ys, lambda y: ~y["over"] & (y["x"]["title"] != ""))
        return F.struct((ys.isNotNull() & F.forall(ys, lambda y: y["regular"])).alias("plain"), F.transform(kept, event).alias("found"))

    v = F.try_parse_json(F.when(held != "", held).otherwise(payload))
    read = _once(_once(v, lambda v: F.transform(F.transform(items(v), told), dated)), both)
    return read["plain"], read["found"]


FEED = "channel struct<item: array<struct<title: array<string>, link: array<string>, description: array<string>, category: array<string>>>>, _broken string"
#: Markup in a description that is read alike: plain tags without entities.
SIMPLE = r"^(?:[^<>&]|</?(?:b|br|div|em|h[1-6]|i|p|span|strong|u)(?:\s[^<>&]*)?/?>)*$"
#: Words of page furniture that are no titles.
FURNITURE = r"(?iu)impressum|datenschutz|cookie|kontakt|newsletter|navigation|men[uü]|login|anmelden|agb\b|startseite|suche|sitemap"


def _feed(name: str, least: int, **fixed):
    def read(payload: Column, now: datetime) -> tuple[Column, Column]:
        feed = F.from_xml(payload, FEED, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"})
        items = F.coalesce(feed["channel"]["item"], F.array().cast("array<struct<title: array<string>, link: array<string>, description: array<string>, category: array<string>>>"))
        last = lambda x, k: F.trim(F.coalesce(F.try_element_at(x[k], F.lit(-1)), F.lit("")))  # noqa: E731  of several the last

        def regular(x: Column) -> Column:
            return last(x, "description").rlike(SIMPLE)

        def event(x: Column) -> Column:
            title, link, about = last(x, "title"), last(x, "link"), last(x, "description")
            texts = F.filter(F.transform(F.split(about, r"<[^<>]*>"), lambda t: F.trim(t)), lambda t: t != "")
            there = lambda k: F.try_element_at(x[k], F.lit(-1)).isNotNull()
            return _event(
                F.coalesce(_filled(link), title), title, source_name=name, source_url=F.when(there("link"), link), short_description=F.array_join(texts, " "), is_permanent_offer=True,
                **{"category": F.when(there("category"), last(x, "category"))} | fixed,
            )

        # every item of the feed is one of the channel's, and its children are plain elements with a text, title and description also without
        found = F.regexp_count(payload, F.lit(r"<item[\s>]")) == F.size(items)
        plain = ~payload.rlike(r"<\w+:(?:title|link|description|category)\b|<(?:title|link|description|category)\s+[^\s/>]|<(?:link|category)\s*/>|<(?:link|category)>\s*</|<!(?:DOCTYPE|ENTITY|--)")
        odd_space = payload.rlike(rf"[\x00-\x08\x0b\x0c\x0e-\x1b{ODD_SPACE}]")
        events = F.filter(F.transform(items, event), lambda e: (F.length(e["title"]) >= least) & ~e["title"].rlike(FURNITURE))
        return feed["_broken"].isNull() & found & plain & ~odd_space & F.forall(items, regular), events

    return read


#: source to (payload, now) -> (whether the shape is the plain one, array of events)
NATIVE = {"Zollverein": _zollverein, "Villa Hügel": _villa_huegel, "Ruhrpott-Kids": _feed("Ruhrpott-Kids", 1, kids_suitable="yes"), "borbeck.de": _feed("borbeck.de", 5, city="Essen")}


def read(payloads: DataFrame, name: str, now: datetime) -> DataFrame:
    """``payloads`` of one source with ``plain``, and where that holds ``found``, the array of its events."""
    plain, found = NATIVE[name](F.col("payload"), now)
    told = payloads.withColumn("_told", F.struct(F.coalesce(plain, F.lit(False)).alias("plain"), found.alias("found")))
    return told.withColumn("plain", F.col("_told.plain")).withColumn("found", F.when(F.col("_told.plain"), F.col("_told.found"))).drop("_told")


def events(payloads: DataFrame, name: str, now: datetime) -> DataFrame:
    """The events of the payloads of one source that have the plain shape, without a Python worker."""
    told = read(dealt(payloads.where(F.col("source_name") == name)), name, now)
    # outer, as Spark would otherwise work out the array a second time to leave out empty ones
    return told.select(F.explode_outer("found").alias("e")).where("e is not null").select("e.*")
