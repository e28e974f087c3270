"""Coordinates by a ladder that writes back what it learns: known venue, cache, geocoder."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityfeed.functions.text import cache_key, geocode_query
from cityfeed.operators.enrich import geocode_ladder
from cityfeed.operators.lifecycle import geocode, put_cache
from cityfeed.sources.schema import GEOCODE_CACHE, conform
from cityfeed.sources.tables import stage

#: Keys that one run asks the geocoder for.
ASKS = 100


@dataclass(frozen=True)
class Located:
    """The events, the cache with the new answers, and the keys that were asked for: ``query, event_id, lat, lon``."""

    events: DataFrame
    cache: DataFrame
    asked: DataFrame


def locate(events: DataFrame, cache: DataFrame, places: DataFrame, now, city: str = "Essen", asks: int | None = ASKS) -> Located:
    """Coordinates of active events that have none.

    What neither a known venue nor a fresh cache entry answers, a miss being an
    answer as well, is asked for: each key once, by its event of least id, the
    keys in the order of these ids and at most ``asks`` of them. The geocoder
    is ``places(query, lat, lon)``; of the event's queries the first that it
    answers counts. Found or not, the answer is put into the cache at ``now``,
    and all events of that key get it; so a second run asks for nothing that
    the first one did. Archived events stay as they are.
    """
    on, off = events.where("archived_at is null"), events.where("archived_at is not null")
    key = cache_key(geocode_query(F.col("venue_name"), F.col("address_text"), F.col("city"), city))
    known = stage(geocode(on, cache, city, now).withColumn("_key", key), "located")
    open_ = known.where("geocoded_by is null and _key <> ''")
    first = open_.groupBy("_key").agg(F.min("id").alias("_first"))
    if asks is not None:
        first = first.orderBy("_first").limit(asks)
    asking = open_.join(first.select(F.col("_key").alias("_asked"), "_first"), (F.col("id") == F.col("_first")) & (F.col("_key") == F.col("_asked"))).select("_key", "id", "venue_name", "address_text", "city")
    asking = stage(asking, "asking")
    found = geocode_ladder(asking, places, city).select(F.col("id").alias("_id"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"))
    answers = stage(asking.join(found, F.col("id") == F.col("_id"), "left").select("_key", F.col("id").alias("event_id"), "_lat", "_lon"), "answers")
    met = known.join(answers.drop("event_id").withColumnRenamed("_key", "_asked"), F.col("_key") == F.col("_asked"), "left")
    fill = lambda c: F.when(F.col("geocoded_by").isNull(), F.coalesce(f"_{c}", c)).otherwise(F.col(c))
    located = met.withColumns({"lat": fill("lat"), "lon": fill("lon")}).select(*events.columns)
    asked = answers.select(F.col("_key").alias("query"), "event_id", F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    entries = conform(asked.withColumn("fetched_at", F.lit(now).cast("timestamp_ntz")), GEOCODE_CACHE)
    return Located(located.unionByName(off), put_cache(conform(cache, GEOCODE_CACHE), entries), asked)
