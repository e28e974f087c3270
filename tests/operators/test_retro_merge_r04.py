"""Faults of the fourth round, F1: the merge made every pair of a busy title before it settled them."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cityfeed.operators import matching, replay

NOW = datetime(2026, 7, 1, 12)
ROWS = "id long, title string, source_name string, start_at timestamp_ntz, archived_at timestamp_ntz, sources_list string, source_count int"


def plain(rows, pairs):
    """Every pair in order, one after the other: id to list and count of what stays."""
    place = lambda i: (rows[i][3], i)
    lists = {i: [x for x in (r[5] or "").split(",") if x] for i, r in rows.items()}
    count, gone, touched = {i: r[6] or 1 for i, r in rows.items()}, set(), set()
    for a, b in sorted(pairs, key=lambda p: (place(p[0]), place(p[1]))):
        if a in gone or b in gone:
            continue
        keep, drop = (a, b) if count[a] >= count[b] else (b, a)
        own, other = rows[keep][2], rows[drop][2]
        if own and own not in lists[keep]:
            lists[keep].insert(0, own)
        if other and other not in lists[keep]:
            lists[keep].append(other)
        count[keep] = len(lists[keep])
        gone.add(drop)
        touched.add(keep)
    return {i: (",".join(lists[i]), count[i]) if i in touched else (r[5], r[6]) for i, r in rows.items() if i not in gone}


@pytest.mark.parametrize("seed, hours, block_days", [(1, 2, 30), (2, 6, 1), (3, 40, 1)])
def test_merge_by_kinds_is_that_of_the_pairs(spark, seed, hours, block_days):
    """Busy and quiet titles, similar ones among them, events without source, list or count, chains over blocks."""
    r = random.Random(seed)
    titles = ["Jazz Abend Park", "Jazz Abend Park Essen", "Abend Park Essen", "Lesung", "Lesung am Abend", "Oper", ""]
    rows, at = {}, datetime(1969, 12, 28, 23)
    for i in r.sample(range(5000), 260):
        at += timedelta(hours=r.choice([0, 0, 0, 1, hours]), microseconds=r.choice([0, 0, 500_000]))
        name = r.choice(["A", "B", "C", None])
        rows[i] = (i, r.choice(titles), name, r.choice([at] * 9 + [None]), r.choice([None] * 9 + [NOW]), r.choice([name, None, "Z", f"{name},Z"]), r.choice([1, 1, 2, None]))
    events = spark.createDataFrame(list(rows.values()), ROWS)
    # exactly twelve hours; a pair counts whole seconds
    pairs = [(p.a_id, p.b_id) for p in matching.retro_pairs(events).collect() if rows[p.b_id][3] - rows[p.a_id][3] <= timedelta(hours=12)]
    want = plain(rows, pairs)
    assert len(pairs) > 50 and len(want) < 240
    on = matching._keyed(events.where("archived_at is null"), {c: c for c in ("id", "start_at", "source_name", "sources_list", "source_count")})
    changes = {x.id: x for x in replay.replay_alike(on.withColumnRenamed("words", "key"), matching._cells(on), 12, block_days).collect()}
    got = {i: (changes[i].new_list, changes[i].new_count) if i in changes and changes[i].touched else (v[5], v[6]) for i, v in rows.items() if i not in changes or not changes[i].gone}
    assert got == want
    if block_days == replay.BLOCK_DAYS:
        assert {x.id: (x.sources_list, x.source_count) for x in matching.retro_merge(events).collect()} == want


def test_work_follows_the_events(monkeypatch):
    """20,000 events at one time have 100,000,000 pairs of different sources; each that is looked at takes an event away."""
    n, looked = 20_000, []
    monkeypatch.setattr(replay, "merge_pair", lambda a, b, f=replay.merge_pair: (looked.append(1), f(a, b)))
    rows = ({"root": 0, "id": k, "start": 0, "key": "jazz", "name": "AB"[k % 2], "sources": [], "n": 1, "gone": False, "touched": False, "partners": None if k else ["jazz"], "hold": replay.NEVER} for k in range(n))
    out = list(replay.settled(rows, 12 * 3_600_000_000, apart=True))
    # the first one takes over all of the other source
    assert [x["id"] for x in out if not x["gone"]] == list(range(0, n, 2)) and len(looked) == n // 2


def test_pairs_are_not_made(spark, monkeypatch):
    events = spark.range(4000).select("id", F.lit("Jazz Abend").alias("title"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("source_name"), F.lit(NOW).cast("timestamp_ntz").alias("start_at"), F.lit(None).cast("timestamp_ntz").alias("archived_at"), F.lit(None).cast("string").alias("sources_list"), F.lit(1).alias("source_count"))
    most = []
    monkeypatch.setattr(matching, "stage", lambda df, name, f=matching.stage: (most.append((out := f(df, name)).count()), out)[1])
    out = matching.retro_merge(events)
    assert out.count() == 2000 and out.where("source_count = 2 and sources_list = 'A,B'").count() == 1
    assert max(most) <= 4000
