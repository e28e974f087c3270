"""Faults of the fourth round, F2: a task got more lists of siblings than a Parquet dictionary holds."""

from collections import defaultdict
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cityfeed.operators import search

ROWS = "id long, title string, source_name string, start_at timestamp_ntz, archived_at timestamp_ntz"
IDS = {"ids": lambda o: F.array_join(F.transform(o, lambda x: x["id"].cast("string")), ","), "n": F.size}


def test_few_different_lists_in_a_task(spark):
    """100 groups, each of 600 events with a list of 11,399 bytes."""
    k = F.col("id") % 100
    events = spark.range(60_000).select((F.lit(10**17) + F.col("id")).alias("id"), F.concat(F.lit("Lesung "), k.cast("string")).alias("title"), F.lit("A").alias("source_name"), F.lit(None).cast("timestamp_ntz").alias("start_at"), F.lit(None).cast("timestamp_ntz").alias("archived_at"))
    out = search.siblings(events, **IDS).withColumn("task", F.spark_partition_id())
    lists = out.groupBy("task", "ids").count().groupBy("task").agg(F.sum(F.length("ids")).alias("bytes"), F.sum("count").alias("n")).collect()
    assert sum(r["n"] for r in lists) == 60_000 and max(r["bytes"] for r in lists) < 800_000


def test_a_large_group_goes_to_many_tasks(spark, monkeypatch):
    """All events have the right list wherever they are dealt to."""
    monkeypatch.setattr(search, "SLOT_EVENTS", 40)
    monkeypatch.setattr(search, "SLOT_TEXT", 300)
    rows, at = [], datetime(2026, 1, 1)
    for i in range(600):
        title = "Oper" if i % 3 else ["Jazz", "Lesung", "", None, "Film"][i % 5]
        source = [None, "A", "", "B"][i % 4] if i % 3 else "A"
        rows.append((i, title, source, None if i % 11 == 0 else at + timedelta(hours=i * 7 % 100), at if i % 5 == 1 or title == "Film" else None))
    lists = defaultdict(list)
    for i, title, source, start, gone in rows:
        if title and not gone:
            lists[title, source].append((start is None, start or at, i))
    want = {(i, ",".join(str(x[2]) for x in sorted(lists[title, source])) or None, len(lists[title, source]) or None) for i, title, source, *_ in rows}
    out = search.siblings(spark.createDataFrame(rows, ROWS), **IDS)
    got = out.withColumn("task", F.spark_partition_id()).collect()
    assert len(got) == 600 and {tuple(r)[:3] for r in got} == want
    busy = [r for r in got if r.n and r.n > 60]
    assert len({r.task for r in busy}) > 4
    plain = {r.event_id: [x.id for x in r.siblings] if r.siblings is not None else None for r in search.siblings(spark.createDataFrame(rows, ROWS)).collect()}
    assert {(i, s and ",".join(map(str, s))) for i, s in plain.items()} == {(i, s) for i, s, _ in want}
    assert search.siblings(spark.createDataFrame([], ROWS), **IDS).collect() == []
