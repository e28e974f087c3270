"""Answers of services that are asked again once they are too old, as state of a stream.

Each key keeps its last answer. A question within the answer's lifetime is
served from it, any other one is asked and replaces it. Whether an answer is
fresh is decided from the times in the data; Spark's time-to-live frees the
state of keys that nobody asks for any more, the longest lifetime later.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cityfeed.sources.tables import shared_root

#: Hours that an answer holds: of a place found or not, of a forecast for today or another day, of a robots.txt.
LIFETIMES = {"geocode": (180 * 24, 14 * 24), "weather": (24, 3), "robots": (1, 1)}
LONGEST_MS = 180 * 24 * 3_600_000

QUESTIONS = "kind string, key string, id long, at timestamp, good boolean"
SERVED = "kind string, key string, id long, asked boolean"
LAST = "at long, holds long"
#: State that Spark frees by itself needs this store; a batch without questions has nothing to do.
SETTINGS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.noDataMicroBatches.enabled": "false"}


def lifetime_ms(kind: str, good: bool) -> int:
    """Milliseconds; ``good`` is a place found, or a forecast for another day than today."""
    long, short = LIFETIMES[kind]
    return (long if good else short) * 3_600_000


class LastAnswer(StatefulProcessor):
    """Per kind and key the time of the last answer and how long it holds."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", LAST, ttlDurationMs=LONGEST_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kind, name = key
        at, holds = self.last.get() if self.last.exists() else (None, 0)
        questions = pd.concat(list(rows)).sort_values(["at", "id"])  # of one key and batch
        asked = []
        for when, good in zip((questions["at"].astype("int64") // _unit(questions["at"])).tolist(), questions["good"].tolist(), strict=True):
            ask = at is None or when - at >= holds
            if ask:
                at, holds = when, lifetime_ms(kind, bool(good))
            asked.append(ask)
        if any(asked):
            self.last.update((at, holds))
        yield pd.DataFrame({"kind": kind, "key": name, "id": questions["id"].to_numpy(), "asked": asked})

    def close(self) -> None:
        pass


def _unit(times: pd.Series) -> int:
    """Ticks of a column of times in a millisecond."""
    return {"ns": 1_000_000, "us": 1_000, "ms": 1}[times.dt.unit]


def answer_stream(questions: DataFrame) -> DataFrame:
    """``kind, key, id, asked`` of a stream of ``QUESTIONS``; those of a batch are taken in the order of time, then id."""
    return questions.groupBy("kind", "key").transformWithStateInPandas(LastAnswer(), SERVED, "Append", "ProcessingTime")


def asked_again(spark: SparkSession, landed: str, root: str | None = None, files: int | None = None) -> DataFrame:
    """Which of the questions in the Parquet files below ``landed`` are asked; the others are served.

    ``root`` keeps the answers and the progress: a later call with the same one
    goes on with what has landed since. Returns all that was written so far.
    """
    root = (root or f"{shared_root(spark)}/answers-{uuid.uuid4().hex}").rstrip("/")
    before = {k: spark.conf.get(k) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        reader = spark.readStream.schema(QUESTIONS)
        if files:
            reader = reader.option("maxFilesPerTrigger", files)
        out = answer_stream(reader.parquet(landed)).writeStream.format("parquet").option("checkpointLocation", f"{root}/progress").trigger(availableNow=True).start(f"{root}/served")
        out.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return spark.read.schema(SERVED).parquet(f"{root}/served")


def questions_of(rows: DataFrame, kind: str, key, id_, at, good) -> DataFrame:
    """Rows in the form of ``QUESTIONS``."""
    return rows.select(F.lit(kind).alias("kind"), key.alias("key"), id_.cast("long").alias("id"), at.cast("timestamp").alias("at"), good.alias("good"))
