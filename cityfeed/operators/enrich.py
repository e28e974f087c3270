"""Images by title word, and places by a ladder of queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.functions.text import truthy

IMAGE_WORD, TITLE_WORD = 4, 5


def _words(c: Column, least: int) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+"), lambda w: F.length(w) >= least)


def attach_images(events: DataFrame, images: DataFrame) -> DataFrame:
    """``events`` with ``image_url`` from ``images(pos, label, url)`` where it is missing.

    The first word of a title that names an image decides; of several images
    with that word the first counts.
    """
    first = images.select(F.explode(F.array_distinct(_words(F.col("label"), IMAGE_WORD))).alias("word"), "pos", "url").groupBy("word").agg(F.min(F.struct("pos", "url"))["url"].alias("url"))
    lacking = events.where(~truthy(F.col("image_url")) | F.col("image_url").isNull())
    asked = lacking.select("id", F.posexplode(_words(F.col("title"), TITLE_WORD)).alias("at", "word"))
    found = asked.join(first, "word").groupBy("id").agg(F.min(F.struct("at", "url"))["url"].alias("found_url"))
    return events.join(found, "id", "left").withColumn("image_url", F.when(truthy(F.col("image_url")), F.col("image_url")).otherwise(F.col("found_url"))).drop("found_url")


def place_queries(venue: Column, address: Column, city: Column, default_city: str) -> Column:
    """The queries for a place in the order they are tried, without repeats."""
    town = F.when(truthy(city), city).otherwise(default_city)
    both = lambda a, b: F.concat(a, F.lit(", "), b)
    ladder = [
        F.when(truthy(venue) & truthy(address), both(venue, address)),
        F.when(truthy(venue), both(venue, town)),
        F.when(truthy(address), both(address, town)),
        F.when(truthy(venue), both(venue, F.lit(f"{default_city}, Germany"))),
    ]
    return F.array_distinct(F.filter(F.array(*ladder), lambda q: q.isNotNull()))


def geocode_ladder(events: DataFrame, places: DataFrame, default_city: str) -> DataFrame:
    """``id, query, lat, lon`` of the first query that ``places(query, lat, lon)`` answers."""
    asked = events.select("id", F.posexplode(place_queries(F.col("venue_name"), F.col("address_text"), F.col("city"), default_city)).alias("at", "query"))
    best = asked.join(places, "query").groupBy("id").agg(F.min(F.struct("at", "query", "lat", "lon")).alias("m"))
    return best.select("id", "m.query", "m.lat", "m.lon")


def with_addresses(events: DataFrame, details: DataFrame) -> DataFrame:
    """Addresses and towns from ``details(source_url, address)``; events of which the address is elsewhere go."""
    from cityfeed.functions.geo import city_of, in_city

    found = details.where(truthy(F.col("address"))).groupBy("source_url").agg(F.min("address").alias("found_address"))
    out = events.join(found, "source_url", "left")
    address = F.coalesce("found_address", "address_text")
    out = out.withColumn("city", F.coalesce(city_of(F.col("found_address")), F.col("city"))).withColumn("address_text", address)
    return out.where(F.col("found_address").isNull() | in_city(F.col("found_address"))).select(*events.columns)


def toggle(favorites: Column, item: Column) -> Column:
    """The list without the item if it held it, else with it at the end."""
    return F.when(F.array_contains(favorites, item), F.array_remove(favorites, item)).otherwise(F.array_append(favorites, item))
