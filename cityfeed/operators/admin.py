"""Counts, problems, crawl history and health of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RECENT_RUNS, HISTORY = 5, 30
STALE_HOURS = 48


def stats(events: DataFrame) -> DataFrame:
    """One row of counts over all events, in one pass; all but total and archived count active ones."""
    on = F.col("archived_at").isNull()
    missing = {
        "no_coords": F.col("lat").isNull() | F.col("lon").isNull(),
        "no_category": F.col("category").isNull() | (F.col("category") == ""),
        "no_date": F.col("start_at").isNull(),
        "no_desc": F.col("short_description").isNull() | (F.col("short_description") == ""),
    }
    out = events.agg(
        F.count("*").alias("total"),
        F.count_if(on).alias("active"),
        *[F.count_if(on & c).alias(k) for k, c in missing.items()],
        F.round(F.avg(F.when(on, F.col("quality_score"))), 3).alias("avg_quality"),
    )
    return out.withColumn("archived", F.col("total") - F.col("active"))


def problem_filter(kind: str) -> Column:
    empty = lambda c: F.col(c).isNull() | (F.col(c) == "")
    kinds = {
        "no_coords": F.col("lat").isNull() | F.col("lon").isNull(),
        "no_date": F.col("start_at").isNull(),
        "no_category": empty("category"),
        "no_desc": empty("short_description"),
    }
    if kind not in kinds:
        raise ValueError(f"unknown kind of problem: {kind}")
    return kinds[kind]


def problems(events: DataFrame, kind: str, limit: int = 50) -> DataFrame:
    """Active events that lack something, newest id first."""
    return events.where("archived_at is null").where(problem_filter(kind)).orderBy(F.col("id").desc()).limit(min(limit, 200))


def count_by(events: DataFrame, column: str, missing: str) -> DataFrame:
    """Active events by a column, nulls under ``missing``; the largest count first."""
    return events.where("archived_at is null").groupBy(F.coalesce(column, F.lit(missing)).alias("name")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "name")


def problem_percent(value: Column, total: Column) -> Column:
    """Rounded half up; 0 of nothing."""
    return F.when(total > 0, F.floor(value / total * 100 + 0.5)).otherwise(0)


def recent_runs(runs: DataFrame, n: int = HISTORY) -> DataFrame:
    return runs.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(n)


def last_runs(runs: DataFrame, n: int = RECENT_RUNS) -> DataFrame:
    """The last runs of each source, numbered from the newest."""
    w = Window.partitionBy("source_name").orderBy(F.col("started_at").desc(), F.col("id").desc())
    return runs.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n)


def sources_health(sources: DataFrame, runs: DataFrame, active: DataFrame, now) -> DataFrame:
    """Status, trend and active events of every source.

    ``unknown`` without runs or while one runs, ``red`` after an error,
    ``yellow`` after a success that found nothing, else ``green``; yellow and
    green turn ``stale`` when the last success among the last runs is over 48
    hours old.
    """
    newest = lambda c: F.min(F.struct("rn", c))[c]
    last = last_runs(runs).groupBy("source_name").agg(
        newest("status").alias("last_status"),
        newest("items_found").alias("last_found"),
        F.max("started_at").alias("last_run_at"),
        F.min(F.when(F.col("status") == "success", F.struct("rn", "finished_at")))["finished_at"].alias("last_success_at"),
        F.transform(F.sort_array(F.collect_list(F.struct("rn", F.coalesce("items_found", F.lit(0)).alias("found")))), lambda x: x["found"]).alias("trend"),
    )
    counts = active.where("archived_at is null").groupBy("source_name").agg(F.count("*").alias("active_count"))
    out = sources.join(last, "source_name", "left").join(counts, "source_name", "left")
    success = F.col("last_status") == "success"
    base = F.when(F.col("last_status") == "error", "red").when(success & (F.coalesce("last_found", F.lit(0)) == 0), "yellow").when(success, "green").otherwise("unknown")
    old = F.col("last_success_at") < F.lit(now) - F.expr(f"INTERVAL {STALE_HOURS} HOURS")
    out = out.withColumn("health", F.when(base.isin("green", "yellow") & old, "stale").otherwise(base))
    return out.withColumn("active_count", F.coalesce("active_count", F.lit(0))).withColumn("trend", F.coalesce("trend", F.array().cast("array<int>")))


def trend_bars(trend: Column) -> Column:
    """Oldest first, as shares of the largest count or of one."""
    return F.transform(F.reverse(trend), lambda x: x / F.greatest(F.lit(1), F.array_max(trend)))
