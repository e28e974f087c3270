"""The whole run: landed payloads of all sources to the next state of the events."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityfeed.functions.classify import classify
from cityfeed.functions.geo import quality_score, with_distance
from cityfeed.functions.weather import with_weather
from cityfeed.operators import lifecycle, matching
from cityfeed.operators.merging import stats_by_source, upsert_all
from cityfeed.sources.parsers import parse_all, unite_pages
from cityfeed.sources.registry import only
from cityfeed.sources.schema import CRAWL_RUNS, EVENTS, conform
from cityfeed.sources.tables import stage

ERROR_CHARS = 2000


@dataclass(frozen=True)
class Synced:
    events: DataFrame
    runs: DataFrame
    totals: dict[str, int]


def enrich(events: DataFrame, cache: DataFrame, weather: DataFrame, city: str, now) -> DataFrame:
    """Classification, places, distance, weather and quality of active events; archived ones stay as they are."""
    on, off = events.where("archived_at is null"), events.where("archived_at is not null")
    on = classify(on)
    on = lifecycle.geocode(on, cache, city, now).drop("geocoded_by")
    on = with_weather(with_distance(on), weather, now.date() if hasattr(now, "date") else date.fromisoformat(str(now)[:10]))
    return on.withColumn("quality_score", quality_score()).select(*events.columns).unionByName(off)


def sync(
    state: DataFrame, payloads: DataFrame, cache: DataFrame, weather: DataFrame, now, city: str = "Essen", sources: list[str] | None = None,
    clear_first: bool = False, clock: Callable[[], datetime] | None = None, on_run: Callable[[tuple], None] | None = None, retention_days: int = lifecycle.RETENTION_DAYS,
) -> Synced:
    """Parse, merge as if source by source, enrich, archive, purge and merge what is the same.

    A source is matched against what those before it brought; ``upsert_all``
    merges the batches of all of them at once. A payload that can't be read is
    logged and stops nothing else; should the merge itself fail, that is the
    error of every run and the events stay as they are. ``clock`` times the
    runs, ``now`` does without it; ``on_run`` gets each row of the log when a
    run starts, as running, and when it ends; the merge takes place within the
    first run. ``clear_first`` starts from no events.
    """
    spark = state.sparkSession
    tick = clock or (lambda: now)
    state = stage(conform(state.limit(0) if clear_first else state, EVENTS), "state")
    landed = stage(parse_all(payloads, now).withColumn("pos", F.monotonically_increasing_id()), "parsed")
    failed = {r["source_name"]: r for r in landed.where("error is not null").groupBy("source_name").agg(F.count("*").alias("n"), F.min("error").alias("error")).collect()}  # a row per source
    parsed = stage(unite_pages(landed.where("error is null").drop("error")), "events")
    names = [s.name for s in only(sources)]
    runs, none = [], dict.fromkeys(("found", "created", "updated", "merged"), 0)
    totals, stats, broken = dict(none), None, None

    def log(*row):
        if on_run:
            on_run(row)
        return row

    for k, name in enumerate(names, 1):
        began = tick()
        log(k, name, began, None, "running", None, None, None, None, None)
        if stats is None:
            try:
                done = upsert_all(state, parsed, names, now)
                stats = {r["source_name"]: r.asDict() for r in stats_by_source(stage(done.outcome, "outcome")).collect()}  # a row per source
                state = stage(done.state, "state")
            except Exception as e:  # what went wrong is in the log of each run
                stats, broken = {}, str(e)
        own, lost = stats.get(name, none), failed.get(name)
        said = broken or (f"{lost['n']} payloads failed: {lost['error']}" if lost else None)
        status = "error" if broken or (lost and not own["found"]) else "success"
        runs.append(log(k, name, began, tick(), status, own["found"], own["created"], own["updated"], own["merged"], said and said[:ERROR_CHARS]))
        totals = {n: totals[n] + own[n] for n in totals}
    events = enrich(state, cache, weather, city, now)
    events = lifecycle.purge_broken_titles(lifecycle.purge_archived(lifecycle.archive_past(events, now), now, retention_days))
    events = matching.retro_merge(stage(events, "events"))
    return Synced(events, spark.createDataFrame(runs, CRAWL_RUNS), totals)
