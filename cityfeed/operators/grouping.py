"""Performances of one production as one row with nested occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cityfeed.functions.text import group_title

OCCURRENCE = ["id", "start_at", "venue_name", "source_url", "is_permanent_offer"]


def group_key(title: Column, source: Column, id_: Column, unicode_form: bool = False) -> tuple[Column, Column]:
    """Normalised title and source; an event without a title is a group of its own."""
    title = group_title(title, unicode_form)
    return F.when(title == "", F.concat(F.lit("__unique_"), id_.cast("string"))).otherwise(title), F.lower(F.coalesce(source, F.lit("")))


def group_events(events: DataFrame, now, unicode_form: bool = False) -> DataFrame:
    """A row per group: the representative's columns, its occurrences by time and the next start.

    The representative is the earliest event from ``now`` on, else the one of
    best quality; ties go to the lower id. Occurrences without a start come
    last. All of it is one aggregation: the representative is a minimum of
    structs, so a group costs one row per map task and its occurrence list.
    """
    key, source = group_key(F.col("title"), F.col("source_name"), F.col("id"), unicode_form)
    now = now if isinstance(now, Column) else F.lit(now)
    start, quality = F.col("start_at"), F.coalesce("quality_score", F.lit(0.0))
    future = start >= now
    whole = F.struct(*events.columns)
    rank = F.struct(F.when(future, 0).otherwise(1).alias("late"), F.when(future, start).alias("start"), F.when(~F.coalesce(future, F.lit(False)), -quality).alias("quality"), F.col("id").alias("id"), whole.alias("row"))
    occurrence = F.struct(start.isNull().alias("undated"), start.alias("start_at"), F.col("id"), *[F.col(c) for c in OCCURRENCE if c not in ("id", "start_at")])
    grouped = events.groupBy(key.alias("group_title"), source.alias("group_source")).agg(
        F.min(rank).alias("best"),
        F.sort_array(F.collect_list(occurrence)).alias("occurrences"),
        F.min(F.when(future, start)).alias("next_at"),
        F.min("start_at").alias("first_at"),
        F.count("*").alias("n_occurrences"),
    )
    return grouped.select(
        "best.row.*",
        "group_title",
        "group_source",
        F.transform("occurrences", lambda o: F.struct(*[o[c].alias(c) for c in OCCURRENCE])).alias("occurrences"),
        F.coalesce("next_at", "first_at").alias("headline_at"),
        "n_occurrences",
    )
