"""Synchronisation at intervals, from payloads that land as files."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityfeed.operators import lifecycle
from cityfeed.operators.sync import sync
from cityfeed.sources.config import Config
from cityfeed.sources.registry import seed
from cityfeed.sources.schema import EVENTS, GEOCODE_CACHE

PAYLOADS = "source_name string, url string, payload string"
SOURCES = "source_name string, base_url string, source_type string, active boolean"
#: Versions of the events that stay; the last batch may be repeated from the one before it.
KEPT = 2


class Versions:
    """Versions of the events below a folder that all executors share.

    ``events-n`` is what batch n left, ``start-n`` the same after a start that
    followed it (-1 before any batch). A batch reads the last version of a
    lower number, so one that is repeated after a failure never reads what it
    writes. Every version is whole, as each batch brings all active events to
    its day; older ones than ``KEPT`` are deleted.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(f"{self.root}/{name}/_SUCCESS"))

    def written(self) -> list[tuple[int, str]]:
        """Number and name of the versions, in the order in which they follow each other."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]
        found = [(int(n.partition("-")[2]), n) for n in names if n.startswith(("events-", "start-"))]
        return sorted((k, n) for k, n in found if self.exists(n))

    def before(self, n: int | None = None) -> DataFrame:
        """The events before batch ``n``, or the last ones."""
        names = [name for k, name in self.written() if n is None or k < n]
        return self.spark.read.schema(EVENTS).parquet(f"{self.root}/{names[-1]}") if names else self.spark.createDataFrame([], EVENTS)

    def write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")

    def forget(self) -> None:
        """Delete the versions of all numbers but the last ones."""
        found = self.written()
        for k, name in found:
            if k not in sorted({k for k, _ in found})[-KEPT:]:
                self.fs.delete(self.path(f"{self.root}/{name}"), True)

    def time_of(self, n: int, now) -> datetime:
        """The time of batch ``n``, written before anything is done with it, so that a repetition has the same."""
        if not self.exists(f"time-{n}"):
            at: datetime = now() if callable(now) else now
            self.spark.createDataFrame([(at.isoformat(),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/time-{n}")
        return datetime.fromisoformat(self.spark.read.text(f"{self.root}/time-{n}").first()[0])


def start(spark: SparkSession, root: str, now: datetime, config: Config = Config()) -> DataFrame:
    """What a start does before the first interval: the sources are registered, past events archived and old ones purged. Returns the events."""
    kept = Versions(spark, root)
    known = spark.read.schema(SOURCES).parquet(f"{root}/sources") if kept.exists("sources") else spark.createDataFrame([], SOURCES)
    names = sorted((tuple(r) for r in seed(known).collect()), key=str)  # a row per source
    kept.write(spark.createDataFrame(names, SOURCES).coalesce(1), "sources")
    last = kept.written()
    n = last[-1][0] if last else -1
    # a start after a start begins from the batch's version as well
    of_batch = spark.read.schema(EVENTS).parquet(f"{root}/events-{n}") if kept.exists(f"events-{n}") else spark.createDataFrame([], EVENTS)
    kept.write(lifecycle.purge_archived(lifecycle.archive_past(of_batch, now), now, config.archive_retention_days), f"start-{n}")
    return kept.before()


def recrawl(spark: SparkSession, landed: str, root: str, now, weather: DataFrame, cache: DataFrame | None = None, config: Config = Config(), once: bool = False, sources: list[str] | None = None) -> DataFrame:
    """Merge the payloads below ``landed`` into the events below ``root`` every ``sync_interval_seconds``, after what a start does.

    ``once`` takes what has landed and returns. ``now`` is a time or a function
    that gives it. A repeated batch has the time and the events of its first
    try and so gives the same. Returns the events after the last batch.
    """
    kept = Versions(spark, root)
    cache = cache if cache is not None else spark.createDataFrame([], GEOCODE_CACHE)
    start(spark, root, now() if callable(now) else now, config)

    def merge(batch: DataFrame, n: int) -> None:
        done = sync(kept.before(n), batch, cache, weather, kept.time_of(n, now), sources=sources, retention_days=config.archive_retention_days)
        kept.write(done.events, f"events-{n}")
        kept.write(done.runs.withColumn("batch", F.lit(n)), f"runs-{n}")
        kept.forget()

    trigger = {"availableNow": True} if once else {"processingTime": f"{config.sync_interval_seconds} seconds"}
    stream = spark.readStream.schema(PAYLOADS).parquet(landed)
    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/progress").trigger(**trigger).start()
    query.awaitTermination()
    return kept.before()
