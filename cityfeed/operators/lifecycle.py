"""Archiving of past events, removal of old ones and of broken titles, lookups with a lifetime."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cityfeed.functions.geo import known_venue
from cityfeed.functions.text import cache_key, geocode_query, is_broken_title, truthy
from cityfeed.functions.weather import geocode_fresh

RETENTION_DAYS = 2
PENDING = 500


def archive_past(events: DataFrame, now) -> DataFrame:
    """Active, dated, past and not permanent events are archived at ``now``."""
    past = F.col("archived_at").isNull() & (F.col("start_at") < F.lit(now)) & ~F.coalesce("is_permanent_offer", F.lit(False))
    return events.withColumn("archived_at", F.when(past, F.lit(now).cast("timestamp_ntz")).otherwise(F.col("archived_at")))


def purge_archived(events: DataFrame, now, retention_days: int = RETENTION_DAYS) -> DataFrame:
    """Without the events archived longer ago than the retention."""
    old = F.col("archived_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(retention_days)} DAYS")
    return events.where(~F.coalesce(old, F.lit(False)))


def purge_broken_titles(events: DataFrame) -> DataFrame:
    return events.where(~is_broken_title(F.col("title")))


def pending_geocode(events: DataFrame, limit: int = PENDING) -> DataFrame:
    """The first active events without coordinates."""
    return events.where("archived_at is null and (lat is null or lon is null)").orderBy("id").limit(limit)


def latest_by_key(cache: DataFrame, key: str, at: str) -> DataFrame:
    """The newest entry of each key."""
    w = Window.partitionBy(key).orderBy(F.col(at).desc())
    return cache.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def put_cache(cache: DataFrame, entries: DataFrame, key: str = "query") -> DataFrame:
    """The cache with entries in place of those of the same key."""
    return cache.join(entries.select(key), key, "left_anti").unionByName(entries)


def geocode(events: DataFrame, cache: DataFrame, city: str, now) -> DataFrame:
    """Coordinates from known venues, else from fresh cache entries, misses included.

    ``geocoded_by`` says where they came from: own, venue, cache, miss, or null
    for what a geocoder would have to be asked.
    """
    venue = known_venue(F.col("venue_name"), F.col("title"))
    key = cache_key(geocode_query(F.col("venue_name"), F.col("address_text"), F.col("city"), city))
    fresh = cache.where(geocode_fresh(F.col("fetched_at"), F.col("lat"), F.lit(now).cast("timestamp_ntz"))).select(F.col("query").alias("_q"), F.col("lat").alias("_lat"), F.col("lon").alias("_lon"), F.lit(True).alias("_hit"))
    out = events.withColumn("_v", venue).join(fresh, key == F.col("_q"), "left")
    own = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    by = F.when(own, "own").when(F.col("_v").isNotNull(), "venue").when(F.col("_hit") & F.col("_lat").isNotNull(), "cache").when(F.col("_hit"), "miss")
    pick = lambda c: F.when(own, F.col(c)).when(F.col("_v").isNotNull(), F.col(f"_v.{c}")).otherwise(F.col(f"_{c}"))
    values = {"lat": pick("lat"), "lon": pick("lon"), "geocoded_by": by}
    if "address_text" in events.columns:
        values["address_text"] = F.when(~own & F.col("_v").isNotNull() & ~truthy(F.col("address_text")), F.col("_v.address")).otherwise(F.col("address_text"))
    return out.withColumns(values).drop("_v", "_q", "_lat", "_lon", "_hit")
