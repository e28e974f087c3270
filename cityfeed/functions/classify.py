"""Category, setting and audience of an event from keywords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cityfeed.functions.text import truthy

#: Categories in the order of lookup and their keywords.
CATEGORY_KEYWORDS = {
    "Familie & Kinder": [
        "kind", "kinder", "famili", "eltern", "kids", "jugend", "schüler",
        "geburtstag", "spiel", "spielplatz", "tochter", "sohn", "baby",
        "mitmach", "puppentheater",
    ],
    "Museum & Ausstellung": [
        "museum", "ausstellung", "kunst", "galerie", "historisch",
        "denkmal", "architektur", "sammlung", "exponat",
    ],
    "Märkte": [
        "markt", "flohmarkt", "weihnachtsmarkt", "basar", "trödelmarkt",
        "bauernmarkt", "streetfood-markt",
    ],
    "Food & Street-Food": [
        "food", "street-food", "streetfood", "essen", "trinken",
        "restaurant", "cafe", "küche", "kochen", "verkostung", "wein",
        "bier", "brunch", "kulinarisch",
    ],
    "Feste & Festivals": [
        "fest", "festival", "feier", "party", "open air", "openair",
        "stadtfest", "sommerfest", "kirmes", "volksfest",
    ],
    "Workshops & Mitmachen": [
        "workshop", "kurs", "seminar", "kreativ", "basteln", "malen",
        "handwerk", "lerne", "mitmach", "diy",
    ],
    "Freizeitorte & Attraktionen": [
        "park", "natur", "wald", "garten", "tier", "zoo", "gruga",
        "schwimmbad", "kletterhalle", "freizeitpark", "see", "rad",
        "sport", "lauf", "marathon", "yoga", "fußball", "tennis",
    ],
    "Kultur & Sonstiges": [
        "kultur", "konzert", "musik", "band", "live", "dj", "jazz",
        "rock", "pop", "klassik", "chor", "theater", "bühne", "show",
        "kabarett", "comedy", "film", "kino", "vorstellung", "drama",
        "lesung", "literatur", "führung", "rundgang", "tour",
        "besichtigung", "kulturerbe",
    ],
}

#: Fixed values.
INDOOR_KEYWORDS = [
    "museum", "theater", "kino", "konzert", "halle", "indoor", "innen",
    "galerie", "ausstellung", "restaurant", "cafe", "kultur", "rade",
]
OUTDOOR_KEYWORDS = [
    "park", "frei", "outdoor", " draußen", "garten", "wald", "wiese",
    "platz", "straße", "lauf", "radweg", "see", "teich",
]


def _quoted(words: list[str]) -> str:
    return "|".join(w.replace(".", r"\.") for w in words)


def _any(text: Column, words: list[str]) -> Column:
    return text.rlike(_quoted(words))


def event_text(title: Column, description: Column, venue: Column) -> Column:
    """What keywords are looked up in."""
    part = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return F.concat_ws(" ", part(title), part(description), part(venue))


def first_match(text: Column, keywords: dict[str, list[str]]) -> Column:
    """The first key with a keyword in the text, else null."""
    return reduce(lambda rest, item: F.when(_any(text, item[1]), item[0]).otherwise(rest), reversed(keywords.items()), F.lit(None).cast("string"))


def category(text: Column) -> Column:
    return first_match(text, CATEGORY_KEYWORDS)


def indoor_outdoor(text: Column, venue: Column) -> Column:
    """Setting by keywords; some venues have the last word."""
    venue = F.lower(F.coalesce(venue, F.lit("")))
    indoor, outdoor = _any(text, INDOOR_KEYWORDS), _any(text, OUTDOOR_KEYWORDS)
    return (
        F.when(venue.contains("zollverein") | text.contains("museum"), "indoor")
        .when(venue.contains("grugapark"), "outdoor")
        .when(indoor & outdoor, "both")
        .when(outdoor, "outdoor")
        .when(indoor, "indoor")
    )


def kids_suitable(source: Column) -> Column:
    return F.when(F.lower(F.coalesce(source, F.lit(""))).contains("ruhrpott"), "yes")


def classify(df):
    """Fill category, indoor_outdoor and kids_suitable where they are missing."""
    text = event_text(F.col("title"), F.col("short_description"), F.col("venue_name"))
    found = {"category": category(text), "indoor_outdoor": indoor_outdoor(text, F.col("venue_name")), "kids_suitable": kids_suitable(F.col("source_name"))}
    return df.withColumns({c: F.when(truthy(F.col(c)), F.col(c)).otherwise(v) for c, v in found.items()})
