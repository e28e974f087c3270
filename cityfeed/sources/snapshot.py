"""The feed as a JSON document: the same input always gives the same bytes."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityfeed.sources.tables import stage

#: What differs from run to run, and helpers of the grouping, stay out.
LEFT_OUT = ("created_at", "updated_at", "group_title", "group_source", "headline_at", "n_occurrences")


def snapshot(groups: DataFrame, now) -> DataFrame:
    """``canonical_id, json``: one minified object with sorted keys per group, NaN refused."""
    columns = sorted(c for c in groups.columns if c not in LEFT_OUT)
    doubles = [c for c, kind in groups.dtypes if kind == "double"]
    checked = groups.withColumns({c: F.when(F.isnan(c), F.raise_error(F.lit(f"NaN in {c}")).cast("double")).otherwise(F.col(c)) for c in doubles})
    return checked.select("canonical_id", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("json"))


def write_snapshot(groups: DataFrame, now, path: str, generated_at: str, weather: dict | None = None, limit: int | None = None) -> dict:
    """Write ``events.json`` lines ordered by canonical_id and a small header; returns the counts.

    The events are sorted and written by the executors, one line each; only
    counts and the header pass through the driver.
    """
    rows = stage(snapshot(groups, now), "snapshot").orderBy("canonical_id")
    total = rows.count()
    if limit is not None:
        rows = rows.limit(limit)
    rows.select(F.col("json").alias("value")).write.mode("overwrite").text(f"{path}/events")
    counts = {"events": min(total, limit) if limit is not None else total, "truncated": limit is not None and total > limit, "occurrences": groups.agg(F.sum(F.size("occurrences"))).first()[0] or 0}
    header = json.dumps({"generated_at": generated_at, "weather_today": weather, **counts}, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)
    groups.sparkSession.createDataFrame([(header,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/header")
    return counts


def read_snapshot(spark, path: str, schema: str) -> DataFrame:
    """The events of a written snapshot, with the given columns; one row per line."""
    return spark.read.schema("value string").text(f"{path}/events").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e")).select("e.*")
