"""Distance, travel time, quality score, known venues and postal codes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.functions.text import truthy
from cityfeed.functions.venues import KNOWN_VENUES

#: Where trips start, the earth's radius, speed and time to set out.
ORIGIN = (51.3833, 7.0333)
EARTH_KM = 6371.0
KM_PER_HOUR, START_MINUTES = 30.0, 5.0

#: What each known fact adds to the quality score.
QUALITY_WEIGHTS = {"start_at": 0.20, "venue": 0.15, "coords": 0.20, "description": 0.10, "category": 0.10, "price": 0.05, "multi_source": 0.20}
DESCRIPTION_CHARS = 30

#: Postal codes of the city.
CITY_CODES = [
    "45127", "45128", "45130", "45131", "45133", "45134", "45136",
    "45138", "45139", "45141", "45143", "45144", "45145", "45147",
    "45149", "45219", "45239", "45257", "45259", "45276", "45277",
    "45279", "45289", "45307", "45309", "45326", "45327", "45329",
    "45355", "45356", "45357", "45359",
]
CITY = "Essen"


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km."""
    a, b, c, d = (F.radians(x if isinstance(x, Column) else F.lit(x)) for x in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((c - a) / 2), 2.0) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2.0)
    return 2 * EARTH_KM * F.asin(F.sqrt(half))


def distance_km(lat: Column, lon: Column) -> Column:
    """From the origin, to one decimal."""
    return F.round(haversine_km(ORIGIN[0], ORIGIN[1], lat, lon), 1)


def travel_minutes(km: Column) -> Column:
    """0 for no distance, else the time to set out and to drive, half to even."""
    return F.when(km <= 0, 0).otherwise(F.bround(START_MINUTES + km / KM_PER_HOUR * 60.0, 0).cast("int"))


def needs_distance() -> Column:
    """Active, placed, and without distance or travel time."""
    return F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("archived_at").isNull() & (F.col("distance_km").isNull() | F.col("travel_time_minutes").isNull())


def with_distance(df: DataFrame) -> DataFrame:
    """Distance and travel time of active rows that have coordinates and lack one of the two."""
    need = needs_distance()
    km = distance_km(F.col("lat"), F.col("lon"))
    return df.withColumns({"distance_km": F.when(need, km).otherwise(F.col("distance_km")), "travel_time_minutes": F.when(need, travel_minutes(km)).otherwise(F.col("travel_time_minutes"))})


def quality_score() -> Column:
    """Sum of the weights of what is known of an event, at most 1, to three decimals."""
    col = F.col
    known = {
        "start_at": col("start_at").isNotNull() | F.coalesce(col("is_permanent_offer"), F.lit(False)),
        "venue": truthy(col("venue_name")) | truthy(col("address_text")),
        "coords": col("lat").isNotNull() & col("lon").isNotNull(),
        "description": F.length("short_description") >= DESCRIPTION_CHARS,
        "category": truthy(col("category")),
        "price": truthy(col("price_text")),
        "multi_source": F.coalesce(col("source_count"), F.lit(1)) > 1,
    }
    return F.round(F.least(F.lit(1.0), sum((F.when(known[k], F.lit(w)).otherwise(F.lit(0.0)) for k, w in QUALITY_WEIGHTS.items()), F.lit(0.0))), 3)


def known_venue(venue: Column, title: Column, venues=KNOWN_VENUES) -> Column:
    """Struct (keyword, lat, lon, address) of the first keyword that venue or title holds, else null."""
    text = F.lower(F.concat_ws(" ", F.coalesce(venue, F.lit("")), F.coalesce(title, F.lit(""))))
    kind = "struct<keyword:string,lat:double,lon:double,address:string>"

    def entry(v):
        return F.struct(F.lit(v[0]).alias("keyword"), F.lit(float(v[1])).alias("lat"), F.lit(float(v[2])).alias("lon"), F.lit(v[3]).alias("address")).cast(kind)

    table = F.array(*[entry(v) for v in venues])
    return F.get(F.filter(table, lambda v: text.contains(v["keyword"])), F.lit(0))


def in_city(address: Column) -> Column:
    """Whether an address may be in the city: by postal code, else by name; an address that says neither may."""
    code = F.regexp_extract(address, r"(?U)\b([0-9]{5})\b", 1)
    return F.when(code == "", True).when(code.isin(CITY_CODES), True).when(code.startswith("45") & address.rlike(rf"(?iu)\b{CITY}\b"), True).otherwise(False)


def city_of(address: Column) -> Column:
    """The name after the postal code."""
    name = F.trim(F.regexp_extract(address, r"[0-9]{5}\s+([^,]+)$", 1))
    return F.when(name != "", name)
