"""The whole run on two small sources."""

from datetime import date, datetime

from cityfeed.operators.enrich import place_queries
from cityfeed.operators.sync import sync
from cityfeed.sources.schema import EVENTS, GEOCODE_CACHE
from pyspark.sql import functions as F

NOW = datetime(2026, 7, 1, 12)


def test_sync(spark):
    state = spark.createDataFrame([], EVENTS)
    cache = spark.createDataFrame([], GEOCODE_CACHE)
    weather = spark.createDataFrame([(date(2026, 7, 3), "Sonne")], "target_date date, hint string")
    text = "03. Juli\nKONZERT UNTER BÄUMEN\nEin Abend im Grünen mit Musik und Gästen.\nEinlass ab 18:30\n20. Juni\nSCHON VORBEI\nText"
    block = '<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://g/1">Konzert unter Bäumen</a></h3><div class="vsel-meta-date">Fr. 3.7.2026</div><div class="vsel-meta-time">20:00</div></div>'
    payloads = spark.createDataFrame([("Gasometer", "https://gas", text), ("GREND", "https://g", block)], "source_name string, url string, payload string")
    done = sync(state, payloads, cache, weather, NOW, sources=["Gasometer", "GREND"])
    out = {r.title: r for r in done.events.collect()}
    assert set(out) == {"KONZERT UNTER BÄUMEN", "SCHON VORBEI"}
    kept = out["KONZERT UNTER BÄUMEN"]
    assert kept.sources_list == "Gasometer,GREND" and kept.source_count == 2 and kept.weather_note == "Sonne" and kept.category == "Kultur & Sonstiges"
    assert kept.distance_km > 0 and kept.travel_time_minutes > 5 and kept.quality_score == 0.95 and kept.archived_at is None
    assert out["SCHON VORBEI"].archived_at == NOW
    assert done.totals == {"found": 3, "created": 2, "updated": 0, "merged": 1}
    assert [(r.source_name, r.status, r.items_merged) for r in done.runs.orderBy("id").collect()] == [("Gasometer", "success", 0), ("GREND", "success", 1)]
    again = sync(done.events, payloads, cache, weather, NOW, sources=["Gasometer"])
    assert again.totals["updated"] == 2 and again.totals["created"] == 0


def test_place_queries(spark):
    row = spark.range(1).select(place_queries(F.lit("Haus"), F.lit("Weg 1"), F.lit(None).cast("string"), "Essen").alias("a"), place_queries(F.lit(""), F.lit("Weg 1"), F.lit("Bochum"), "Essen").alias("b")).first()
    assert row.a == ["Haus, Weg 1", "Haus, Essen", "Weg 1, Essen", "Haus, Essen, Germany"] and row.b == ["Weg 1, Bochum"]


def test_failures_are_logged(spark):
    rows = [("Zollverein", "a", '[{"title": "x", "startDate": {"at": 1}}]'), ("GREND", "g", '<div class="vsel-content"><h3 class="vsel-meta-title">Lesung am Abend</h3><div class="vsel-meta-date">3.7.2026</div></div>'), ("GREND", "h", None)]
    payloads = spark.createDataFrame(rows, "source_name string, url string, payload string")
    weather = spark.createDataFrame([], "target_date date, hint string")
    ticks, seen = iter(range(100)), []
    done = sync(spark.createDataFrame([], EVENTS), payloads, spark.createDataFrame([], GEOCODE_CACHE), weather, NOW, sources=["Zollverein", "GREND"], clock=lambda: NOW.replace(minute=next(ticks)), on_run=seen.append)
    runs = {r.source_name: r for r in done.runs.collect()}
    assert runs["Zollverein"].status == "error" and "AttributeError" in runs["Zollverein"].error_log and runs["GREND"].status == "success"
    assert [r[4] for r in seen] == ["running", "error", "running", "success"] and runs["GREND"].finished_at > runs["GREND"].started_at
    assert [r.title for r in done.events.collect()] == ["Lesung am Abend"]
    cleared = sync(done.events, payloads.limit(0), spark.createDataFrame([], GEOCODE_CACHE), weather, NOW, sources=["GREND"], clear_first=True)
    assert cleared.events.count() == 0


def test_numbers_need_no_single_task(spark):
    from cityfeed.operators.matching import numbered

    rows = spark.range(1000).selectExpr("id * 7 % 1000 AS k")
    assert [(r.k, r.n) for r in numbered(rows, "k").orderBy("k").collect()] == [(k, k + 1) for k in range(1000)]
    assert numbered(rows.limit(0), "k").collect() == []


def test_upsert_counts_and_names(spark):
    from cityfeed.operators import matching
    from cityfeed.sources.schema import conform

    at = datetime(2026, 7, 3, 20)
    old = conform(spark.createDataFrame([(5, "k5", "Sommer Nacht Fest", at, "A", "A", 1), (6, "k6", "Anderes Konzert Heute", at, None, "", 1)], "id long, canonical_id string, title string, start_at timestamp_ntz, source_name string, sources_list string, source_count int"), EVENTS)
    batch = spark.createDataFrame([("n1", "Sommer Nacht Fest", at, " Saal\u200b  Eins "), ("n2", "Sommer Nacht Fest", at, "x"), ("n3", "Anderes Konzert Heute", at, "y")], "canonical_id string, title string, start_at timestamp_ntz, venue_name string").withColumn("pos", F.col("canonical_id"))
    done = matching.upsert(old, batch, "B", NOW)
    assert matching.sync_stats(done.outcome).first().asDict() == {"found": 3, "created": 1, "updated": 0, "merged": 1}
    out = {r.canonical_id: r for r in done.state.collect()}
    assert out["k5"].sources_list == "A,B" and out["n3"].id == 9  # numbered after the two that merge; an event without source is nobody's double
    again = matching.upsert(done.state, batch.where("canonical_id = 'n1'"), "B", NOW)
    assert matching.sync_stats(again.outcome).first().asDict() == {"found": 1, "created": 0, "updated": 0, "merged": 0}
    fresh = matching.upsert(old.limit(0), batch.where("canonical_id = 'n1'"), "B", NOW).state.first()
    assert fresh.venue_name == "Saal Eins"


def test_stream_goes_on(spark, tmp_path):
    from cityfeed.streaming.upsert import BucketedState, upsert_stream

    kind = "k long, ts int, v string"
    put = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda: {r.k: (r.ts, r.v) for r in upsert_stream(spark, f"{tmp_path}/in", "k", root=f"file://{tmp_path}/state", files=1).collect()}
    put([(k, 1, "a") for k in range(200)])
    assert run() == {k: (1, "a") for k in range(200)}
    put([(3, 2, "b"), (500, 1, "c")])
    put([(3, 1, "late")])
    want = {k: (1, "a") for k in range(200)} | {3: (2, "b"), 500: (1, "c")}
    assert run() == want
    state = BucketedState(spark, f"file://{tmp_path}/state", spark.read.parquet(f"{tmp_path}/in").schema, "k", "ts")
    last = state.manifests()[-1]
    for _ in range(2):  # a repeated batch gives the same
        state.merge(spark.createDataFrame([(3, 1, "late")], kind), last)
        assert {r.k: (r.ts, r.v) for r in state.last().collect()} == want
    assert run() == want
