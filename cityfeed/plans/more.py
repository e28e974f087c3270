"""Queries of synchronisation, client lists, weather and statistics."""

from __future__ import annotations

import uuid
from datetime import date, datetime

from pyspark.sql import functions as F

from cityfeed.functions import dates, geo, text, weather
from cityfeed.operators import admin, search
from cityfeed.operators.matching import numbered
from cityfeed.operators.search import ClientState
from cityfeed.plans.ev import NOW, NOW_SQL, VISIBLE_SQL, ev, grouped_sql, with_ev
from cityfeed.plans.registered import query
from cityfeed.sources.registry import SOURCES
from cityfeed.sources.tables import shared_root, table

GROUPS_SQL = f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')}"


def _groups(spark, d):
    return search.feed(ev(spark, d), NOW)


def _register_client_sorts() -> None:
    by = {
        "smart": "effective_at NULLS LAST, coalesce(quality_score, 0) DESC, id",
        "quality": "coalesce(quality_score, 0) DESC, effective_at NULLS LAST, id",
        "travel": "travel_time_minutes NULLS LAST, effective_at NULLS LAST, id",
        "start_at": "effective_at NULLS LAST, id",
    }
    for name, order in by.items():
        sql = with_ev(
            GROUPS_SQL + ", x AS (SELECT id, quality_score, travel_time_minutes, unnest(occurrences) AS o, is_permanent_offer FROM groups),"
            f" y AS (SELECT id, quality_score, travel_time_minutes, min(o.start_at) AS effective_at FROM x WHERE o.start_at IS NULL OR o.start_at >= {NOW_SQL} OR is_permanent_offer GROUP BY ALL)"
            f" SELECT row_number() OVER (ORDER BY {order})::INTEGER AS place, id, effective_at FROM y"
        )

        def run(spark, d, name=name):
            listed = search.client_feed(_groups(spark, d), NOW, ClientState(range="", max_travel_time=0, sort=name))
            return numbered(listed, search.client_order(name), "place").select(F.col("place").cast("int").alias("place"), "id", "effective_at")

        query(sql, f"client_sort_{name}")(run)


_register_client_sorts()


@query(with_ev(GROUPS_SQL + " SELECT DISTINCT category FROM groups WHERE lat IS NOT NULL AND lon IS NOT NULL AND category <> ''"))
def map_legend(spark, d):
    return search.map_legend(_groups(spark, d))


@query(
    with_ev(
        GROUPS_SQL + " SELECT floor((lon + 180) / 360 * 65536 / 40)::BIGINT AS cell_x, floor((0.5 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / (2 * pi())) * 65536 / 40)::BIGINT AS cell_y,"
        " count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM groups WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2"
    )
)
def map_pixel_clusters(spark, d):
    return search.pixel_clusters(_groups(spark, d), 8)


@query(with_ev(GROUPS_SQL + " SELECT id, o.id AS occurrence FROM (SELECT id, unnest(occurrences) AS o FROM groups) WHERE o.id = 17"))
def find_occurrence(spark, d):
    """The group that holds an event."""
    out = search.find_by_any_id(_groups(spark, d), 17)
    return out.select("id", F.lit(17).cast("long").alias("occurrence"))


@query(with_ev(GROUPS_SQL + " SELECT id FROM groups WHERE coalesce(category NOT IN ('1-URGENT', '5-LOW'), true) AND indoor_outdoor IN ('indoor', 'both') AND lower(coalesce(title, '') || ' ' || coalesce(venue_name, '') || ' ' || coalesce(short_description, '')) LIKE '%red%'"))
def client_filters(spark, d):
    state = ClientState(range="", excluded=("1-URGENT", "5-LOW"), indoor_outdoor="indoor", max_travel_time=0, q=" RED ")
    return _groups(spark, d).where(search.client_group_filter(state)).select("id")


@query(with_ev("SELECT id, lat IS NOT NULL AND archived_at IS NULL AND id % 3 > 0 AS needs FROM ev"))
def needs_distance(spark, d):
    e = ev(spark, d)
    unknown = F.col("id") % 3
    e = e.withColumn("distance_km", F.when(unknown != 1, F.col("distance_km"))).withColumn("travel_time_minutes", F.when(unknown != 2, F.col("travel_time_minutes")))
    return e.select("id", geo.needs_distance().alias("needs"))


@query(with_ev("SELECT count(*) AS n, floor(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM ev WHERE archived_at IS NULL) + 0.5)::BIGINT AS percent FROM ev WHERE archived_at IS NULL AND source_name = 'BUILDING'"))
def source_share(spark, d):
    """Active events of one source, and their share in percent, rounded half up."""
    counts = ev(spark, d).where("archived_at is null").agg(F.count_if(F.col("source_name") == "BUILDING").alias("n"), F.count("*").alias("total"))
    return counts.select("n", admin.problem_percent(F.col("n"), F.col("total")).cast("long").alias("percent"))


@query(
    "WITH r AS (SELECT user_id % 23 AS s, event_id, ts, floor(value)::INTEGER % 7 AS f, row_number() OVER (PARTITION BY user_id % 23 ORDER BY ts DESC, event_id DESC) AS rn FROM events)"
    " SELECT s AS source, string_agg(round(coalesce(f, 0)::DOUBLE / greatest(1, m), 4)::VARCHAR, ',' ORDER BY rn DESC) AS bars FROM (SELECT *, max(coalesce(f, 0)) OVER (PARTITION BY s) AS m FROM r WHERE rn <= 5) GROUP BY 1"
)
def trend_bars(spark, d):
    runs = table(spark, d, "events").select((F.col("user_id") % 23).alias("source_name"), F.col("event_id").alias("id"), F.col("ts").alias("started_at"), (F.floor("value").cast("int") % 7).alias("f"))
    trend = admin.last_runs(runs).groupBy("source_name").agg(F.transform(F.sort_array(F.collect_list(F.struct("rn", F.coalesce("f", F.lit(0)).alias("f")))), lambda x: x["f"]).alias("t"))
    return trend.select(F.col("source_name").alias("source"), F.array_join(F.transform(admin.trend_bars(F.col("t")), lambda x: F.round(x, 4).cast("string")), ",").alias("bars"))


@query(
    "SELECT event_id, 'Tag ' || CASE (ts::DATE - DATE '2024-01-10') WHEN 0 THEN 'Heute' WHEN 1 THEN 'Morgen' ELSE CASE WHEN (ts::DATE - DATE '2024-01-10') BETWEEN 2 AND 6 AND isodow(ts) IN (6, 7) THEN 'Wochenende' ELSE '-' END END AS label FROM events"
)
def day_labels(spark, d):
    label = dates.day_label(F.col("ts"), F.lit(date(2024, 1, 10)))
    return table(spark, d, "events").select("event_id", F.concat(F.lit("Tag "), F.coalesce(label, F.lit("-"))).alias("label"))


@query(
    "SELECT o_orderkey, o_orderdate + CASE o_orderkey % 3 WHEN 0 THEN INTERVAL 0 HOUR WHEN 1 THEN INTERVAL 9 HOUR + INTERVAL 5 MINUTE ELSE INTERVAL 18 HOUR + INTERVAL 30 MINUTE END AS read FROM orders"
)
def date_formats(spark, d):
    """One of several written forms per order, read by the first that fits."""
    k, day = F.col("o_orderkey") % 3, F.col("o_orderdate")
    written = F.when(k == 0, F.date_format(day, "dd.MM.yyyy")).when(k == 1, F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T09:05:00"))).otherwise(F.concat(F.date_format(day, "dd.MM.yyyy"), F.lit(" 18:30")))
    return table(spark, d, "orders").select("o_orderkey", dates.parse_plain(written).alias("read"))


@query("SELECT c_custkey, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS name, CASE c_custkey % 4 WHEN 0 THEN 'https://h.net/a' WHEN 1 THEN 'https://s.net/a' WHEN 2 THEN 'https://s.net/b/' || c_custkey::VARCHAR END AS link FROM customer")
def names_and_links(spark, d):
    k = F.col("c_custkey")
    link = F.when(k % 4 == 0, "//h.net/a").when(k % 4 == 1, "/a").when(k % 4 == 2, F.concat(F.lit("b/"), k.cast("string"))).otherwise("")
    return table(spark, d, "customer").select("c_custkey", text.capitalise(F.col("c_mktsegment")).alias("name"), text.absolute_url(link, "https://s.net/").alias("link"))


@query("SELECT p_partkey, 'Konzert ' || p_name AS title, 'Er sagt \"' || p_name || '\" / so' AS said FROM part")
def listing_titles(spark, d):
    name = F.col("p_name")
    raw = F.concat(F.lit("TAGESTIPP22Mo, 01. Juni | 19:00 Konzert "), name, F.lit(" Fr, 5. Juni abends 12,00 €"))
    script = F.concat(F.lit(r"Er sagt \""), name, F.lit(r"\" \/ so"))
    return table(spark, d, "part").select("p_partkey", text.clean_listing_title(raw).alias("title"), text.js_unescape(script).alias("said"))


@query(
    "WITH l AS (SELECT doc_id, p, lines[p] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"
    " SELECT doc_id, (p - 1)::INTEGER AS pos, first_value(CASE WHEN length(line) > 60 THEN length(line) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)::INTEGER AS next_long FROM l"
)
def text_first_acceptable(spark, d):
    from cityfeed.sources.lines import first_acceptable, numbered_lines

    lines = numbered_lines(table(spark, d, "documents"), "doc_id", "text")
    return first_acceptable(lines, "doc_id", F.when(F.length("line") > 60, F.length("line")), 1, 5, "next_long").select("doc_id", "pos", "next_long")


WEATHER_SQL = "SELECT DATE '1998-06-01' + (event_id % 20)::INTEGER AS day, (event_id % 41)::DOUBLE - 5 AS warm, (event_id % 101)::INTEGER AS rain, (event_id % 100)::INTEGER AS code, ts, event_id FROM events WHERE event_id % 9 <> 0"


def _answers(spark, d):
    k = F.col("event_id")
    daily = F.struct(
        F.array(F.lit("x")).alias("time"), F.array((k % 41).cast("double") - 5).alias("temperature_2m_max"), F.array(F.lit(1.0)).alias("temperature_2m_min"), F.array((k % 101).cast("int")).alias("precipitation_probability_max"), F.array((k % 100).cast("int")).alias("weathercode")
    )
    payload = F.when(k % 9 == 0, '{"daily": {}}').otherwise(F.to_json(F.struct(daily.alias("daily"))))
    return table(spark, d, "events").select(F.date_add(F.lit(date(1998, 6, 1)), (k % 20).cast("int")).alias("target_date"), payload.alias("payload"), F.col("ts").alias("fetched_at"))


@query(f"SELECT day AS target_date, warm AS temp_max, rain AS rain_probability, code AS weather_code, ts AS fetched_at FROM ({WEATHER_SQL})")
def weather_rows(spark, d):
    return weather.forecast_rows(_answers(spark, d)).select("target_date", "temp_max", "rain_probability", "weather_code", "fetched_at")


@query(f"SELECT day AS target_date, max(ts) AS fetched_at FROM ({WEATHER_SQL}) GROUP BY 1")
def weather_cache(spark, d):
    rows = weather.forecast_rows(_answers(spark, d))
    return weather.put_forecasts(rows.limit(0), rows).select("target_date", "fetched_at")


@query(
    f"SELECT day AS target_date, floor(warm + 0.5)::BIGINT::VARCHAR || '°C' AS temperature, rain::VARCHAR || '% Regen' AS rain, CASE WHEN code >= 95 THEN 'thunder' WHEN code >= 71 THEN 'snow' WHEN code >= 61 THEN 'rain' WHEN code >= 51 THEN 'drizzle' WHEN code <= 1 THEN 'sun' ELSE 'cloud' END AS icon"
    f" FROM ({WEATHER_SQL}) WHERE day = DATE '1998-06-03' QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) = 1"
)
def weather_banner(spark, d):
    k = F.col("event_id")
    rows = table(spark, d, "events").where(k % 9 != 0).select(
        F.date_add(F.lit(date(1998, 6, 1)), (k % 20).cast("int")).alias("target_date"), ((k % 41).cast("double") - 5).alias("temp_max"), (k % 101).cast("int").alias("rain_probability"), (k % 100).cast("int").alias("weather_code"), F.lit("").alias("hint"), "ts", "event_id"
    )
    newest = rows.groupBy("target_date").agg(F.max(F.struct("ts", "event_id", "temp_max", "rain_probability", "weather_code", "hint")).alias("m")).select("target_date", "m.*")
    return weather.banner(newest, date(1998, 6, 3)).select("target_date", "temperature", "rain", "icon")


@query("SELECT query, lat, lon FROM (SELECT 'place ' || c_custkey::VARCHAR AS query, CASE WHEN c_custkey % 2 = 0 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS lat, 1.0::DOUBLE AS lon FROM customer)")
def cache_put(spark, d):
    from cityfeed.operators.lifecycle import put_cache
    from cityfeed.sources.schema import GEOCODE_CACHE, conform

    c = table(spark, d, "customer").select(F.concat(F.lit("place "), F.col("c_custkey").cast("string")).alias("query"), F.lit(1.0).alias("lat"), F.lit(1.0).alias("lon"), "c_custkey")
    cache = conform(c, GEOCODE_CACHE)
    return put_cache(cache, conform(c.where("c_custkey % 2 = 0").withColumn("lat", F.lit(2.0)), GEOCODE_CACHE)).select("query", "lat", "lon")


@query("SELECT user_id AS k, max(ts) AS at FROM events GROUP BY 1")
def newest_by_key(spark, d):
    from cityfeed.operators.lifecycle import latest_by_key

    return latest_by_key(table(spark, d, "events").select(F.col("user_id").alias("k"), F.col("ts").alias("at")), "k", "at").select("k", "at")


@query("SELECT c_custkey, CASE WHEN c_custkey % 5 < 2 THEN ['yes', 'likely'][(c_custkey % 5 + 1)::INTEGER] END AS kids, NULL::INTEGER AS travel_time_minutes FROM customer")
def conform_schema(spark, d):
    """Rows without most columns of the event table, brought to its schema, and values outside an enumeration dropped."""
    from cityfeed.sources.schema import EVENTS, KIDS_SUITABLE, conform, in_enum

    said = F.element_at(F.array(*[F.lit(x) for x in ("yes", "likely", "vielleicht", "", "ja")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    rows = conform(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), said.alias("kids_suitable"), F.lit(1).alias("further")), EVENTS)
    return rows.select(F.col("id").alias("c_custkey"), in_enum("kids_suitable", KIDS_SUITABLE).alias("kids"), "travel_time_minutes")


@query(
    "WITH known AS (SELECT CASE WHEN s_suppkey = 0 THEN 'Gasometer' ELSE s_name END AS source_name, 'http://old/' || s_suppkey::VARCHAR AS base_url, s_suppkey % 2 = 0 AS active FROM supplier),"
    " reg(source_name, base_url) AS (VALUES " + ", ".join(f"('{s.name}', '{s.base_url}')" for s in SOURCES) + ")"
    " SELECT * FROM known WHERE source_name NOT IN (SELECT source_name FROM reg) UNION ALL SELECT source_name, base_url, true FROM reg"
)
def source_seed(spark, d):
    """The registered sources inserted or updated by name among suppliers as sources of the user's own, which stay as they are."""
    from cityfeed.sources.registry import seed

    k = F.col("s_suppkey")
    known = table(spark, d, "supplier").select(F.when(k == 0, "Gasometer").otherwise(F.col("s_name")).alias("source_name"), F.concat(F.lit("http://old/"), k.cast("string")).alias("base_url"), F.lit("rss").alias("source_type"), (k % 2 == 0).alias("active"))
    return seed(known).select("source_name", "base_url", "active")


SYNC_DAY = datetime(2026, 6, 1, 12)
_EVERY = "make_timestamp(2026, 6, (p_partkey % 20 + 5)::BIGINT, 20, 0, 0)"


def _landed(spark, d):
    """A page of one source for every part, and of a second one for every other."""
    k, day = F.col("p_partkey").cast("string"), (F.col("p_partkey") % 20 + 5).cast("string")
    part = table(spark, d, "part")
    block = F.concat(F.lit('<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://g/'), k, F.lit('">Lesung '), k, F.lit('</a></h3><div class="vsel-meta-date">Fr. '), day, F.lit('.6.2026</div><div class="vsel-meta-time">20:00</div></div>'))
    box = F.concat(F.lit('<div class="box event"><a href="/v/'), k, F.lit('"></a><h3 class="event-title">Lesung '), k, F.lit('</h3><p class="event-timing">'), day, F.lit(".06.2026 21:00 Uhr</p></div>"))
    first = part.select(F.lit("GREND").alias("source_name"), F.lit("https://g").alias("url"), block.alias("payload"))
    return first.union(part.where("p_partkey % 2 = 0").select(F.lit("Lichtburg"), F.lit("https://l"), box))


SYNCED_SQL = (
    f"SELECT 'Lesung ' || p_partkey::VARCHAR AS title, {_EVERY} AS start_at, 'literatur' AS category, CASE WHEN p_partkey % 2 = 0 THEN 'GREND,Lichtburg' ELSE 'GREND' END AS sources_list, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END AS source_count,"
    " CASE WHEN p_partkey % 20 = 0 THEN 'Sonne' END AS weather_note, CASE WHEN p_partkey % 2 = 0 THEN 0.85::DOUBLE ELSE 0.65::DOUBLE END AS quality_score FROM part"
)


def _weather(spark):
    return spark.createDataFrame([(date(2026, 6, 5), "Sonne"), (date(2026, 6, 20), "Regen")], "target_date date, hint string")


SYNCED = ("title", "start_at", "category", "sources_list", "source_count", "weather_note", "quality_score")


@query(SYNCED_SQL)
def full_sync(spark, d):
    """Two sources from their pages to the merged, enriched events."""
    from cityfeed.operators.sync import sync
    from cityfeed.sources.schema import EVENTS, GEOCODE_CACHE

    done = sync(spark.createDataFrame([], EVENTS), _landed(spark, d), spark.createDataFrame([], GEOCODE_CACHE), _weather(spark), SYNC_DAY, sources=["GREND", "Lichtburg"])
    return done.events.select(*SYNCED)


@query("SELECT 'GREND' AS source_name, 'success' AS status, count(*)::INTEGER AS items_found, count(*)::INTEGER AS items_created, 0 AS items_merged FROM part UNION ALL SELECT 'Lichtburg', 'success', count(*)::INTEGER, 0, count(*)::INTEGER FROM part WHERE p_partkey % 2 = 0")
def sync_log(spark, d):
    """The crawl log of ``full_sync``."""
    from cityfeed.operators.sync import sync
    from cityfeed.sources.schema import EVENTS, GEOCODE_CACHE

    done = sync(spark.createDataFrame([], EVENTS), _landed(spark, d), spark.createDataFrame([], GEOCODE_CACHE), _weather(spark), SYNC_DAY, sources=["GREND", "Lichtburg"])
    return done.runs.select("source_name", "status", "items_found", "items_created", "items_merged")


@query(SYNCED_SQL)
def stream_recrawl(spark, d):
    """``full_sync`` from payloads that land as files, taken by the stream that re-crawls at intervals."""
    from cityfeed.streaming.recrawl import recrawl

    root = f"{shared_root(spark)}/recrawl-{uuid.uuid4().hex}"
    _landed(spark, d).write.parquet(f"{root}/landed")
    return recrawl(spark, f"{root}/landed", f"{root}/state", SYNC_DAY, _weather(spark), once=True, sources=["GREND", "Lichtburg"]).select(*SYNCED)


@query(with_ev(GROUPS_SQL + " SELECT canonical_id, title, quality_score, n_occurrences FROM groups"))
def snapshot_round_trip(spark, d):
    """The snapshot written, and read as a client does."""
    from cityfeed.sources.snapshot import read_snapshot, write_snapshot

    path = f"{shared_root(spark)}/snapshot-{uuid.uuid4().hex}"
    write_snapshot(_groups(spark, d), NOW, path, "1998-06-01T12:00:00")
    out = read_snapshot(spark, path, "canonical_id string, title string, quality_score double, occurrences array<struct<id:long>>")
    return out.select("canonical_id", "title", "quality_score", F.size("occurrences").cast("long").alias("n_occurrences"))
