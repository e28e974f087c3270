"""What is kept from run to run, and what is settled in rounds."""

import random
import tracemalloc
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from cityfeed.operators import matching, replay
from cityfeed.operators.firstcome import first_come
from cityfeed.operators.places import locate
from cityfeed.operators.search import radius_clusters
from cityfeed.sources.schema import EVENTS, GEOCODE_CACHE, conform
from cityfeed.sources.tables import stage

NOW = datetime(2026, 7, 1, 12)


# --- the greedy merge


def plain_merge(rows, pairs):
    """Every pair in order, one after the other; rows are id: [start, source, list, count]."""
    gone = set()
    place = lambda i: (rows[i][0], i)
    for a, b in sorted(pairs, key=lambda p: (place(p[0]), place(p[1]))):
        if a in gone or b in gone:
            continue
        keep, drop = (a, b) if rows[a][3] >= rows[b][3] else (b, a)
        names = rows[keep][2]
        if rows[keep][1] and rows[keep][1] not in names:
            names.insert(0, rows[keep][1])
        if rows[drop][1] and rows[drop][1] not in names:
            names.append(rows[drop][1])
        rows[keep][3] = len(names)
        gone.add(drop)
    return {i: (",".join(v[2]), v[3]) for i, v in rows.items() if i not in gone}


@pytest.mark.parametrize("seed, block_days", [(1, 1), (3, 30)])
def test_replay_over_blocks(spark, seed, block_days):
    """Chains over many days, cut into blocks, against the plain loop."""
    r = random.Random(seed)
    rows, at = {}, NOW
    for i in r.sample(range(1000), 120):
        at += timedelta(hours=r.choice([0, 1, 5, 7, 11, 12, 13]))
        name = r.choice("ABCDE")
        rows[i] = [at, name, r.choice([[name], [], ["Z"]]), r.choice([1, 1, 2])]
    ids = sorted(rows, key=lambda i: (rows[i][0], i))
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if rows[b][0] - rows[a][0] <= timedelta(hours=12) and r.random() < 0.8]
    events = spark.createDataFrame([(i, v[0], v[1], ",".join(v[2]), v[3]) for i, v in rows.items()], "id long, start_at timestamp_ntz, source_name string, sources_list string, source_count int")
    from cityfeed.operators.graph import components

    table = stage(spark.createDataFrame(pairs, "a_id long, b_id long"), "pairs")
    out = replay.replay(events, table, components(table.toDF("a", "b")), 12, block_days).collect()
    touched = {i for p in pairs for i in p}
    want = {i: v for i, v in plain_merge(rows, pairs).items() if i in touched}
    assert {x.id: (x.new_list, x.new_count) for x in out if not x.gone} == want and {x.id for x in out} == touched


def test_million_events_in_one_chain():
    """A chain streams through in the memory of half a day."""
    n, hour = 1_000_000, 3_600_000_000

    def rows():
        for k in range(n):
            yield {"root": 0, "id": k, "start": k * 6 * hour, "name": "AB"[k % 2], "sources": ["AB"[k % 2]], "n": 1, "gone": False, "touched": False, "partners": [k + 1], "hold": replay.NEVER}

    tracemalloc.start()
    gone = seen = 0
    for row in replay.settled(rows(), 12 * hour):
        seen += 1
        gone += row["gone"]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == n and gone == n // 2 and peak < 2_000_000


def test_long_chain_as_a_whole(spark):
    """A daily title over years: found, merged and counted by the operator itself."""
    n = 2000
    events = spark.range(n).select(F.col("id"), F.lit("Sommer Nacht Fest").alias("title"), F.timestamp_add("HOUR", (F.col("id") * 6).cast("int"), F.lit(NOW).cast("timestamp_ntz")).alias("start_at"), F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("source_name"))
    events = conform(events.withColumn("sources_list", F.col("source_name")).withColumn("source_count", F.lit(1)), EVENTS)
    out = matching.retro_merge(events)
    # each even one takes the next one in and has two sources
    assert out.count() == n // 2 and out.where("source_count = 2 and sources_list = 'A,B'").count() == n // 2


# --- first come


@pytest.mark.parametrize("seed", range(2))
def test_first_come(spark, seed):
    r = random.Random(seed)
    pairs = {(p, r.randrange(p)) for p in range(1, 60) for _ in range(r.randrange(0, 4))}
    fate, match = {}, {}
    for p in range(60):
        there = [q for q in range(p) if (p, q) in pairs and fate[q] == "created"]
        fate[p], match[p] = ("merged", min(there)) if there else ("created", p)
    out = {x.p: (x.fate, x.match) for x in first_come(spark.createDataFrame([(*x, False) for x in pairs], "p long, q long, own boolean")).collect()}
    assert out == {p: (fate[p], match[p]) for p, _ in pairs}
    assert first_come(spark.createDataFrame([], "p long, q long, own boolean")).collect() == []


def test_radius_clusters(spark):
    import math

    r = random.Random(5)
    points = [(i, 51.4 + r.random() * 0.3, 6.9 + r.random() * 0.4) for i in r.sample(range(500), 150)] + [(900 + i, 51.45, 7.0) for i in range(5)] + [(990, None, 7.0)]
    size = 256.0 * 2**10
    pixel = lambda lat, lon: (math.floor((lon + 180) / 360 * size), math.floor((0.5 - math.log(math.tan(math.radians(lat)) + 1 / math.cos(math.radians(lat))) / (2 * math.pi)) * size))
    anchors, count = [], {}
    for i, lat, lon in sorted(p for p in points if p[1] is not None):
        x, y = pixel(lat, lon)
        home = next((a for a, ax, ay in anchors if (x - ax) ** 2 + (y - ay) ** 2 <= 1600), None)
        if home is None:
            anchors.append((i, x, y))
            home = i
        count[home] = count.get(home, 0) + 1
    out = radius_clusters(spark.createDataFrame(points, "id long, lat double, lon double"), 10).collect()
    assert {x.anchor: x.n for x in out} == count and 3 < len(count) < 150


# --- places


def test_places_are_written_back(spark):
    rows = [(1, "Fest", "Haus A", None, None, None), (2, "Fest", "HAUS  a", None, None, None), (3, "Fest", "Haus B", "Weg 1", None, None), (4, "Fest", "Haus C", None, None, None), (5, "Fest im Grugapark", "x", None, None, None), (6, "Fest", "Haus D", None, None, NOW), (7, "Fest", "Haus E", None, 1.0, None)]
    events = conform(spark.createDataFrame([(i, t, v, a, x, x, z) for i, t, v, a, x, z in rows], "id long, title string, venue_name string, address_text string, lat double, lon double, archived_at timestamp_ntz"), EVENTS)
    places = spark.createDataFrame([("Haus A, Essen", 50.0, 6.0), ("Weg 1, Essen", 52.0, 8.0)], "query string, lat double, lon double")
    cache = spark.createDataFrame([("haus c||essen", None, None, NOW - timedelta(days=20))], GEOCODE_CACHE)
    one = locate(events, cache, places, NOW, asks=2)
    assert [(r.query, r.event_id, r.lat) for r in one.asked.orderBy("event_id").collect()] == [("haus a||essen", 1, 50.0), ("haus b|weg 1|essen", 3, 52.0)]
    lat = {r.id: r.lat for r in one.events.collect()}
    assert lat == {1: 50.0, 2: 50.0, 3: 52.0, 4: None, 5: lat[5], 6: None, 7: 1.0} and lat[5] is not None
    two = locate(one.events, one.cache, places, NOW, asks=2)
    assert [(r.query, r.lat) for r in two.asked.collect()] == [("haus c||essen", None)]  # the old miss is asked again
    three = locate(two.events, two.cache, places, NOW + timedelta(days=13), asks=2)
    assert three.asked.count() == 0
    four = locate(two.events, two.cache, places, NOW + timedelta(days=15), asks=2)
    assert [r.query for r in four.asked.collect()] == ["haus c||essen"]
    assert locate(events.limit(0), cache, places, NOW).asked.count() == 0


# --- answers with a lifetime


def test_answers_go_on(spark, tmp_path):
    from cityfeed.streaming.answers import QUESTIONS, asked_again

    at = lambda h: NOW + timedelta(hours=h)
    put = lambda rows: spark.createDataFrame(rows, QUESTIONS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: {r.id: r.asked for r in asked_again(spark, f"{tmp_path}/in", root=f"file://{tmp_path}/state").collect()}
    put([("robots", "a", 1, at(0), True), ("robots", "a", 2, at(0.9), True), ("robots", "a", 3, at(1), True), ("robots", "b", 4, at(1), True), ("weather", "d", 5, at(0), False), ("geocode", "g", 6, at(0), False)])
    assert run() == {1: True, 2: False, 3: True, 4: True, 5: True, 6: True}
    put([("robots", "a", 7, at(1.5), True), ("robots", "b", 8, at(2), True), ("weather", "d", 9, at(2.9), True), ("weather", "d", 10, at(3), True), ("weather", "d", 11, at(26), True), ("geocode", "g", 12, at(14 * 24 - 1), True), ("geocode", "g", 13, at(14 * 24), True), ("geocode", "g", 14, at(190 * 24), True)])
    assert {k: v for k, v in run().items() if k > 6} == {7: False, 8: True, 9: False, 10: True, 11: False, 12: False, 13: True, 14: False}


# --- synchronisation at intervals


def test_recrawl_starts_and_repeats(spark, tmp_path):
    from cityfeed.streaming.recrawl import PAYLOADS, Versions, recrawl

    root, weather = f"file://{tmp_path}/state", spark.createDataFrame([(date(2026, 7, 3), "Sonne")], "target_date date, hint string")
    block = '<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://g/{}">Lesung {}</a></h3><div class="vsel-meta-date">Fr. {}.7.2026</div><div class="vsel-meta-time">20:00</div></div>'
    put = lambda k, day: spark.createDataFrame([("GREND", "https://g", block.format(k, k, day))], PAYLOADS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    clock = iter([NOW, NOW, NOW + timedelta(days=3), NOW + timedelta(days=3), NOW + timedelta(days=9), NOW + timedelta(days=9)])
    run = lambda: {r.title: r.archived_at for r in recrawl(spark, f"{tmp_path}/in", root, lambda: next(clock), weather, once=True, sources=["GREND"]).collect()}
    put(1, 3)
    assert run() == {"Lesung 1": None}
    assert spark.read.parquet(f"{tmp_path}/state/sources").count() == 19
    put(2, 8)
    assert run() == {"Lesung 1": NOW + timedelta(days=3), "Lesung 2": None}  # the start archives what is over
    put(3, 30)
    assert run() == {"Lesung 2": NOW + timedelta(days=9), "Lesung 3": None}  # and purges what is old
    kept = Versions(spark, root)
    assert sorted({k for k, _ in kept.written()}) == [1, 2]
    assert kept.time_of(2, lambda: 1 / 0) == NOW + timedelta(days=9)  # a repeated batch has the time of its first try
