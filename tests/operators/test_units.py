"""Grouping, lifecycle, merging and functions on small inputs."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cityfeed.functions import classify, dates, geo, text, weather
from cityfeed.operators import admin, lifecycle, matching, search
from cityfeed.operators.grouping import group_events
from cityfeed.operators.search import ClientState, Facets
from cityfeed.sources.snapshot import snapshot, write_snapshot

NOW = datetime(2099, 3, 20, 12)
EV = (
    "id long, canonical_id string, title string, short_description string, start_at timestamp_ntz, is_permanent_offer boolean, category string, source_name string, source_url string, venue_name string, address_text string,"
    "lat double, lon double, kids_suitable string, indoor_outdoor string, price_text string, quality_score double, source_count int, sources_list string, archived_at timestamp_ntz, distance_km double, travel_time_minutes int"
)
NAMES = [c.split()[0] for c in EV.split(",")]


def frame(spark, *rows):
    full = [{"is_permanent_offer": False, "quality_score": 0.5, "source_name": "A", "canonical_id": f"c{r['id']}"} | r for r in rows]
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in full], EV)


def at(day, hour=10):
    return datetime(2099, 3, day, hour)


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_grouping(spark):
    e = frame(
        spark,
        dict(id=1, title="Die Oper", start_at=at(10), quality_score=0.9),
        dict(id=2, title="oper!", start_at=at(25), quality_score=0.1),
        dict(id=3, title="Oper", start_at=at(22), quality_score=0.2),
        dict(id=4, title="Oper", source_name="B", start_at=None),
        dict(id=5, title=None),
        dict(id=6, title="  "),
        dict(id=7, title="Oper", start_at=None),
    )
    out = {r.id: r for r in group_events(e, NOW).collect()}
    assert set(out) == {3, 4, 5, 6}
    assert [o.id for o in out[3].occurrences] == [1, 3, 2, 7] and out[3].headline_at == at(22) and out[3].n_occurrences == 4


def test_group_without_future_takes_quality(spark):
    e = frame(spark, dict(id=1, title="x y", start_at=at(1), quality_score=0.3), dict(id=2, title="x y", start_at=at(2), quality_score=0.8), dict(id=3, title="x y", quality_score=None))
    (r,) = group_events(e, NOW).collect()
    assert r.id == 2 and r.headline_at == at(1)


def test_search(spark):
    e = frame(
        spark,
        dict(id=1, title="a one", start_at=at(21, 9), category="Musik", kids_suitable="yes", indoor_outdoor="both", travel_time_minutes=10),
        dict(id=2, title="b two", start_at=at(22, 20), category="Kultur", indoor_outdoor="outdoor", travel_time_minutes=50),
        dict(id=3, title="c three", start_at=at(1), is_permanent_offer=True),
        dict(id=4, title="d four", start_at=at(1)),
        dict(id=5, title="e five", start_at=at(23), archived_at=at(19)),
    )
    ids = lambda **f: [r.id for r in search.search(e, NOW, Facets(**f)).collect()]
    assert ids() == [3, 1, 2]
    assert ids(category="Musik") == [1] and ids(kids_only=True) == [1] and ids(indoor_outdoor="outdoor") == [1, 2]
    assert ids(max_travel_time=30) == [3, 1] and ids(max_travel_time=0) == [3, 1, 2] and ids(time_of_day="evening") == [2]
    assert ids(start_date=date(2099, 3, 22), end_date=date(2099, 3, 22)) == [2] and ids(favorites="c1,,c9") == [1] and ids(q="B_TW") == [2]
    with pytest.raises(ValueError):
        search.search(e, NOW, limit=201)
    groups = search.feed(e, NOW)
    shown = search.client_feed(groups, NOW, ClientState(range="all", max_travel_time=0))
    assert {r.id for r in shown.collect()} == {1, 2, 3}
    assert [r.id for r in search.permanent_extras(groups, shown.where("id = 1"), ClientState(time_of_day="evening")).collect()] == [3]
    assert search.permanent_extras(groups, shown, ClientState(range="all")).count() == 0
    assert search.find_by_any_id(groups, 2).first().id == 2


def test_client_state_round_trip():
    state = ClientState(range="weekend", excluded=("A & B", "C"), kids_only=True, max_travel_time=0, q="x y")
    assert ClientState.from_query(state.to_query()) == state and ClientState().to_query() == ""


def test_lifecycle(spark):
    e = frame(spark, dict(id=1, title="x", start_at=at(19)), dict(id=2, title="x", start_at=at(21)), dict(id=3, title="x", start_at=at(19), is_permanent_offer=True), dict(id=4, title="x", start_at=at(1), archived_at=at(15)), dict(id=5, title="x", archived_at=datetime(2099, 3, 20)), dict(id=6, title=None, start_at=at(19), is_permanent_offer=None))
    out = {r.id: r.archived_at for r in lifecycle.archive_past(e, NOW).collect()}
    assert out == {1: NOW, 2: None, 3: None, 4: at(15), 5: datetime(2099, 3, 20), 6: NOW}
    assert {r.id for r in lifecycle.purge_archived(e, NOW).collect()} == {1, 2, 3, 5, 6}
    broken = ["Sa, 30. Mai | 10:00 Markt", "5Di, 12. Mai | 18:00", "PRÄSENTIERT8Fr, 26. Jun | 16:00 x", "präsentiert Übermorgen, 1. März | 9:30", "Konzert", "Mai 10:00", None]
    t = frame(spark, *[dict(id=k, title=x) for k, x in enumerate(broken)])
    assert {r.id for r in lifecycle.purge_broken_titles(t).collect()} == {4, 5, 6}


def test_geocode(spark):
    cache = spark.createDataFrame([("haus x|weg 1|essen", 51.0, 7.0, at(1)), ("haus y||essen", None, None, at(19)), ("haus z||essen", None, None, at(1))], "query string, lat double, lon double, fetched_at timestamp_ntz")
    e = frame(spark, dict(id=1, venue_name="Haus X", address_text="Weg 1"), dict(id=2, venue_name="Haus Y"), dict(id=3, venue_name="Haus Z"), dict(id=4, venue_name="Im Grugapark"), dict(id=5, venue_name="Haus X", lat=1.0, lon=2.0)).withColumn("city", F.lit(None).cast("string"))
    out = {r.id: (r.geocoded_by, r.lat, r.address_text) for r in lifecycle.geocode(e, cache, "Essen", NOW).collect()}
    assert out[1] == ("cache", 51.0, "Weg 1") and out[2][0] == "miss" and out[3][0] is None and out[4] == ("venue", 51.4293, "Virchowstr. 4, 45147 Essen") and out[5][:2] == ("own", 1.0)


def test_upsert(spark):
    state = frame(
        spark,
        dict(id=1, title="Old", source_name="A", price_text="5", source_count=1, sources_list="A"),
        dict(id=2, title="Jazz Abend", source_name="B", start_at=at(21, 20), source_count=1, sources_list=""),
        dict(id=3, title="Jazz Abend", source_name="A", start_at=at(25, 20), source_count=1, sources_list="A"),
    )
    batch = spark.createDataFrame(
        [("c1", "New", None, at(22), "p" * 600), ("c1", "Again", None, None, None), ("x1", "jazz-abend!", None, at(22, 7), None), ("x2", None, None, None, None), ("x3", "Fresh​  one", "d", None, None), ("", "no id", None, None, None), (None, "no id", None, None, None)],
        "canonical_id string, title string, short_description string, start_at timestamp_ntz, price_text string",
    ).withColumn("pos", F.monotonically_increasing_id())
    done = matching.upsert(state, batch, "A", NOW)
    out = {r.canonical_id: r for r in done.state.collect()}
    assert set(out) == {"c1", "c2", "c3", "x3"}
    assert out["c1"].title == "New" and len(out["c1"].price_text) == 255 and out["c1"].start_at == at(22)
    assert out["c2"].sources_list == "B,A" and out["c2"].source_count == 2 and out["c3"].source_count == 1
    assert out["x3"].title == "Fresh one" and out["x3"].id == 4 or out["x3"].id > 3
    stats = matching.sync_stats(done.outcome).first()
    assert (stats.found, stats.created, stats.updated, stats.merged) == (4, 1, 1, 1)


def test_retro_merge(spark):
    e = frame(
        spark,
        dict(id=1, title="Jazz Abend", source_name="A", start_at=at(21, 8), source_count=1),
        dict(id=2, title="Jazz am Abend", source_name="B", start_at=at(21, 20), source_count=2, sources_list="B,C"),
        dict(id=3, title="Jazz Abend", source_name="C", start_at=at(22, 7), source_count=1),
        dict(id=4, title="Jazz Abend", source_name="A", start_at=at(27), source_count=1),
        dict(id=5, title="Anderes", source_name="D", start_at=at(21, 9), source_count=1),
    )
    out = {r.id: (r.source_count, r.sources_list) for r in matching.retro_merge(e).collect()}
    # 1 and 2 meet first and 2 has more sources; 3 then falls to 2
    assert out == {2: (3, "B,C,A"), 4: (1, None), 5: (1, None)}


def test_health(spark):
    runs = [("A", 1, "success", 3, 19), ("A", 2, "error", 0, 20), ("B", 3, "success", 0, 20), ("C", 4, "success", 7, 20), ("D", 5, "success", 7, 10), ("E", 6, "running", None, 20)]
    runs = spark.createDataFrame([(s, k, st, f, at(day, 9), at(day, 10)) for s, k, st, f, day in runs], "source_name string, id long, status string, items_found int, started_at timestamp_ntz, finished_at timestamp_ntz")
    names = spark.createDataFrame([(x,) for x in "ABCDEF"], "source_name string")
    out = {r.source_name: r for r in admin.sources_health(names, runs, frame(spark, dict(id=1, title="x")), NOW).collect()}
    assert {k: r.health for k, r in out.items()} == {"A": "red", "B": "yellow", "C": "green", "D": "stale", "E": "unknown", "F": "unknown"}
    assert out["A"].trend == [0, 3] and out["A"].active_count == 1 and out["F"].trend == []
    with pytest.raises(ValueError):
        admin.problem_filter("other")


def test_text_functions(spark):
    lit = lambda s: F.lit(s).cast("string")
    assert one(spark, text.sanitize_title(lit("​ a ­  b\n"))) == "a b" and one(spark, text.sanitize_title(lit(" ⁠ "))) is None
    assert one(spark, text.dedup_title(lit("Das Café – presents: Über_1 & DIE"))) == "café über_1"
    assert one(spark, text.group_title(lit("ﬁlm"), True)) == "film" and one(spark, text.group_title(lit(None))) == ""
    assert one(spark, text.clamp(lit("ab   cd"), 4)) == "ab" and one(spark, text.clamp(lit("abcd"), 4)) == "abcd"
    assert one(spark, text.add_url if hasattr(text, "add_url") else text.absolute_url(lit("/x"), "https://s/")) == "https://s/x"
    assert one(spark, text.js_unescape(lit(r"a\"b\n\/c"))) == 'a"b /c' and one(spark, text.capitalise(lit("eSSEN"))) == "Essen"
    assert one(spark, text.clean_listing_title(lit("TAGESTIPP22Mo, 1. Jun | 19:00 Konzert im Park ab 12 €"))) == "Konzert im Park"
    assert one(spark, text.clean_listing_title(lit("x" * 181))) == ""
    assert one(spark, text.geocode_query(lit(None), lit("Weg 1"), lit(""), "Essen")) == "Weg 1|Essen"


def test_dates(spark):
    lit = lambda s: F.lit(s).cast("string")
    got = lambda s: one(spark, dates.parse_german(lit(s), F.lit(2026)))
    assert got("7. Juli 2025, 18:30") == datetime(2025, 7, 7, 18, 30) and got("12. Mai") == datetime(2026, 5, 12) and got("So. 14.6.26 20 Uhr") == datetime(2026, 6, 14, 20)
    assert got("31. Februar 2026") is None and got("nichts") is None and got(None) is None
    assert one(spark, dates.berlin_from_iso(lit("2026-07-01T20:00:00Z"))) == datetime(2026, 7, 1, 22) and one(spark, dates.berlin_from_iso(lit("2026-01-01T20:00"))) == datetime(2026, 1, 1, 20)
    bounds = lambda day: one(spark, F.struct(*dates.range_bounds("weekend", F.lit(day))))
    assert tuple(bounds(date(2026, 6, 3))) == (date(2026, 6, 6), date(2026, 6, 7)) == tuple(bounds(date(2026, 6, 7)))
    assert one(spark, dates.day_label(F.lit(date(2026, 6, 6)), F.lit(date(2026, 6, 3)))) == "Wochenende"


def test_geo_and_weather(spark):
    assert one(spark, geo.travel_minutes(F.lit(0.0))) == 0 and one(spark, geo.travel_minutes(F.lit(10.0))) == 25 and one(spark, geo.travel_minutes(F.lit(0.25))) == 6
    assert abs(one(spark, geo.haversine_km(51.3833, 7.0333, F.lit(51.4556), F.lit(7.0116))) - 8.18) < 0.1
    for address, yes in (("Platz 1, 45309 Essen", True), ("See 20, 40878 Ratingen", False), ("Weg 8, 45470 Mülheim", False), ("x, 45999 Essen", True), ("Wiese", True)):
        assert one(spark, geo.in_city(F.lit(address))) is yes
    hint = lambda r, c, t: one(spark, weather.hint(F.lit(r), F.lit(c), F.lit(t)))
    assert hint(0, 95, 20.0).startswith("Gewitter") and hint(70, 0, 20.0).startswith("Regen") and hint(0, 2, 20.5) == "20°C - Gut bei jedem Wetter" and "Warm (30" in hint(0, 0, 30.0)


def test_classify(spark):
    e = frame(spark, dict(id=1, title="Kinderfest im Museum", venue_name="Grugapark"), dict(id=2, title="Flohmarkt", category="X"), dict(id=3, title="zzz", source_name="Ruhrpott-Kids"), dict(id=4, title="Lauf", venue_name="GRUGAPARK"))
    out = {r.id: (r.category, r.indoor_outdoor, r.kids_suitable) for r in classify.classify(e).collect()}
    assert out == {1: ("Familie & Kinder", "indoor", None), 2: ("X", None, None), 3: (None, None, "yes"), 4: ("Freizeitorte & Attraktionen", "outdoor", None)}


def test_snapshot_is_deterministic(spark, tmp_path):
    e = frame(spark, dict(id=2, title="b", start_at=at(21)), dict(id=1, title="a", start_at=at(22)))
    groups = search.feed(e, NOW)
    assert write_snapshot(groups, NOW, f"file://{tmp_path}/one", "t") == {"events": 2, "truncated": False, "occurrences": 2}
    write_snapshot(search.feed(e.orderBy("id"), NOW), NOW, f"file://{tmp_path}/two", "t")
    lines = lambda n: [r.value for r in spark.read.text(f"file://{tmp_path}/{n}/events").collect()]
    assert lines("one") == lines("two") and '"canonical_id":"c1"' in lines("one")[0]
    with pytest.raises(Exception, match="NaN"):
        snapshot(groups.withColumn("lat", F.lit(float("nan"))), NOW).collect()


@pytest.mark.parametrize("heavy", [100_000, 3])
def test_components_of_chains_stars_and_hubs(spark, monkeypatch, heavy):
    import random

    from cityfeed.operators import graph

    monkeypatch.setattr(graph, "HEAVY", heavy)
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5100)] + [(9000, k) for k in range(8000, 8050)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_service_parameters():
    with pytest.raises(ValueError):
        search.time_of_day_named("nachts")
    assert Facets(q="  a b ", kids_only=True, category="all", max_travel_time=30).to_query() == "kids_only=true&max_travel_time=30&q=a+b"


def test_config():
    from cityfeed.sources.config import Config

    assert Config.from_env({"SYNC_INTERVAL_SECONDS": "60", "NOMINATIM_CONTACT": ""}) == Config(sync_interval_seconds=60)
    with pytest.raises(ValueError):
        Config.from_env({"ARCHIVE_RETENTION_DAYS": "two"})


def test_now_in_berlin(spark):
    row = spark.range(1).select(dates.now_berlin().alias("n"), F.current_timestamp().cast("long").alias("s")).first()
    from zoneinfo import ZoneInfo

    assert abs((row.n - datetime.fromtimestamp(row.s, ZoneInfo("Europe/Berlin")).replace(tzinfo=None)).total_seconds()) < 2
