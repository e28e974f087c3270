"""All registered queries and their DuckDB counterparts."""

from __future__ import annotations

import hashlib
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityfeed.functions import classify, dates, geo, text, weather
from cityfeed.functions.venues import KNOWN_VENUES
from cityfeed.operators import admin, lifecycle, matching, merging, search
from cityfeed.operators.search import ClientState, Facets
from cityfeed.plans.ev import NOW, NOW_SQL, VISIBLE_SQL, ev, grouped_sql, with_ev
from cityfeed.plans.registered import ORACLE_SQL, QUERIES, query  # noqa: F401
from cityfeed.sources.registry import SOURCES, sources
from cityfeed.sources.tables import table

def _feed_columns(df: DataFrame) -> DataFrame:
    ids = F.array_join(F.transform("occurrences", lambda o: o["id"].cast("string")), ",").alias("occurrence_ids")
    return df.select("id", "title", "source_name", "category", "quality_score", "headline_at", "n_occurrences", ids)


FEED = "id, title, source_name, category, quality_score, headline_at, n_occurrences, occurrence_ids"


def _feed_sql(where: str = "true") -> str:
    return with_ev(f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL} AND ({where}))')} SELECT {FEED} FROM groups")


@query(_feed_sql())
def events_feed(spark, d):
    return _feed_columns(search.feed(ev(spark, d), NOW))


#: canonical_ids of some events of the derived table, with an empty entry.
FAVORITES = "," + ",".join(hashlib.md5(f"ev_{k}".encode()).hexdigest()[:16] for k in range(0, 15_000, 17))


def _in_sql(csv: str) -> str:
    return ", ".join(f"'{x}'" for x in csv.split(",") if x)


FACETS = {
    "search": (Facets(q=" e_o "), "title ILIKE '%e_o%' OR venue_name ILIKE '%e_o%' OR short_description ILIKE '%e_o%'"),
    "dates": (Facets(start_date=date(1998, 6, 5), end_date=date(1998, 7, 5)), "start_at >= TIMESTAMP '1998-06-05' AND start_at < TIMESTAMP '1998-07-06'"),
    "category": (Facets(category="1-URGENT"), "category = '1-URGENT'"),
    "kids": (Facets(kids_only=True), "kids_suitable IN ('yes', 'likely')"),
    "indoor": (Facets(indoor_outdoor="indoor"), "indoor_outdoor IN ('indoor', 'both')"),
    "outdoor": (Facets(indoor_outdoor="outdoor"), "indoor_outdoor IN ('outdoor', 'both')"),
    "travel": (Facets(max_travel_time=60), "travel_time_minutes <= 60 OR travel_time_minutes IS NULL"),
    "morning": (Facets(time_of_day="morning"), "extract(hour FROM start_at) < 12"),
    "afternoon": (Facets(time_of_day="afternoon"), "extract(hour FROM start_at) BETWEEN 12 AND 17"),
    "evening": (Facets(time_of_day="evening"), "extract(hour FROM start_at) >= 18"),
    "vormittags": (Facets(time_of_day="vormittags"), "extract(hour FROM start_at) < 12"),
    "nachmittags": (Facets(time_of_day="nachmittags"), "extract(hour FROM start_at) BETWEEN 12 AND 17"),
    "abends": (Facets(time_of_day="abends"), "extract(hour FROM start_at) >= 18"),
    "favorites": (Facets(favorites=FAVORITES), f"canonical_id IN ({_in_sql(FAVORITES)})"),
}


def _register_facets() -> None:
    for name, (facets, where) in FACETS.items():
        query(_feed_sql(where), f"facet_{name}")(lambda spark, d, facets=facets: _feed_columns(search.feed(ev(spark, d), NOW, facets)))
    order = {
        "smart": "headline_at NULLS LAST, coalesce(quality_score, 0) DESC, id",
        "quality": "coalesce(quality_score, 0) DESC, headline_at NULLS LAST, id",
        "travel": "travel_time_minutes NULLS LAST, headline_at NULLS LAST, id",
        "start_at": "headline_at NULLS LAST, id",
    }
    for name, by in order.items():
        capped = f"(SELECT * FROM ev WHERE {VISIBLE_SQL} ORDER BY start_at NULLS LAST, id LIMIT 500)"
        sql = with_ev(f", {grouped_sql(capped)} SELECT {FEED} FROM groups ORDER BY {by} LIMIT 50")
        query(sql, f"sort_{name}")(lambda spark, d, name=name: _feed_columns(search.search(ev(spark, d), NOW, sort=name)))


_register_facets()


@query(
    with_ev(
        ", l AS (SELECT title_key, source_name, string_agg(id::VARCHAR, ',' ORDER BY start_at NULLS LAST, id) AS sibling_ids, count(*) AS n_siblings FROM ev WHERE archived_at IS NULL AND title_key <> '' GROUP BY ALL)"
        " SELECT k.id AS event_id, coalesce(sibling_ids, k.id::VARCHAR) AS sibling_ids, coalesce(n_siblings, 1) AS n_siblings FROM ev k LEFT JOIN l ON l.title_key = k.title_key AND l.source_name IS NOT DISTINCT FROM k.source_name"
    )
)
def event_siblings(spark, d):
    """The active siblings of every event, itself where there are none."""
    out = search.siblings(ev(spark, d), ids=lambda o: F.array_join(F.transform(o, lambda x: x["id"].cast("string")), ","), n=F.size)
    return out.select("event_id", F.coalesce("ids", F.col("event_id").cast("string")).alias("sibling_ids"), F.coalesce("n", F.lit(1)).cast("long").alias("n_siblings"))


DETAIL = (
    "id, canonical_id, title, short_description, start_at, is_permanent_offer, category, source_name, source_url, venue_name, address_text, lat, lon, distance_km, travel_time_minutes, indoor_outdoor, kids_suitable,"
    " price_text, quality_score, source_count, sources_list, archived_at"
)


@query(
    with_ev(
        f" SELECT {', '.join('e.' + c for c in DETAIL.split(', '))}, coalesce((SELECT string_agg(o.id::VARCHAR, ',' ORDER BY o.start_at NULLS LAST, o.id) FROM ev o WHERE o.archived_at IS NULL AND o.title_key = e.title_key AND o.source_name = e.source_name),"
        " e.id::VARCHAR) AS occurrence_ids FROM ev e WHERE e.id = 17"
    )
)
def event_detail(spark, d):
    ids = F.array_join(F.transform("occurrences", lambda o: o["id"].cast("string")), ",").alias("occurrence_ids")
    return search.detail(ev(spark, d), 17).select(*DETAIL.split(", "), ids)


def _client_sql(first: str, last: str, travel: int) -> str:
    return with_ev(
        f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')}, x AS (SELECT id, title, unnest(occurrences) AS o, is_permanent_offer FROM groups WHERE travel_time_minutes <= {travel} OR travel_time_minutes IS NULL)"
        f" SELECT id, title, min(o.start_at) AS effective_at FROM x WHERE (o.start_at IS NULL OR o.start_at >= {NOW_SQL} OR is_permanent_offer) AND o.start_at::DATE BETWEEN DATE '{first}' AND DATE '{last}' GROUP BY ALL"
    )


def _groups(spark, d):
    return search.feed(ev(spark, d), NOW)


@query(_client_sql("1998-06-01", "1998-06-01", 9999))
def client_feed_today(spark, d):
    return search.client_feed(_groups(spark, d), NOW, ClientState(max_travel_time=0)).select("id", "title", "effective_at")


@query(_client_sql("1998-06-06", "1998-06-07", 400))
def client_feed_weekend(spark, d):
    return search.client_feed(_groups(spark, d), NOW, ClientState(range="weekend", max_travel_time=400)).select("id", "title", "effective_at")


@query(
    with_ev(
        f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')}, shown AS (SELECT DISTINCT id FROM (SELECT id, unnest(occurrences) AS o, is_permanent_offer FROM groups WHERE travel_time_minutes <= 30 OR travel_time_minutes IS NULL)"
        f" WHERE (o.start_at IS NULL OR o.start_at >= {NOW_SQL} OR is_permanent_offer) AND o.start_at::DATE = DATE '1998-06-01')"
        " SELECT id, title FROM groups WHERE is_permanent_offer AND (travel_time_minutes <= 30 OR travel_time_minutes IS NULL) AND id NOT IN (SELECT id FROM shown)"
    )
)
def permanent_extras(spark, d):
    groups, state = _groups(spark, d), ClientState()
    return search.permanent_extras(groups, search.client_feed(groups, NOW, state), state).select("id", "title")


@query(with_ev(f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')}, b AS (SELECT id, quality_score FROM groups WHERE quality_score >= 0.6 ORDER BY quality_score DESC, id LIMIT 3) SELECT * FROM b WHERE (SELECT count(*) FROM b) >= 2"))
def top_picks(spark, d):
    return search.top_picks(_groups(spark, d)).select("id", "quality_score")


@query(with_ev(f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')} SELECT DISTINCT category FROM (SELECT category FROM groups WHERE kids_suitable IN ('yes', 'likely') AND (travel_time_minutes <= 30 OR travel_time_minutes IS NULL) AND category <> '' UNION ALL SELECT 'X')"))
def available_categories(spark, d):
    return search.available_categories(_groups(spark, d), ClientState(kids_only=True, category="X"))


@query(with_ev(f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')} SELECT count(*) AS n_groups, count(lat) AS n_points, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM groups"))
def map_bbox(spark, d):
    return search.bounding_box(_groups(spark, d))


@query(with_ev(f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')} SELECT floor(lat / 0.5::DOUBLE)::BIGINT AS cell_lat, floor(lon / 0.5::DOUBLE)::BIGINT AS cell_lon, count(*) AS n, round(avg(lat), 6) AS lat, round(avg(lon), 6) AS lon FROM groups WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY 1, 2"))
def map_clusters(spark, d):
    return search.clusters(_groups(spark, d), 0.5)


@query(
    with_ev(
        f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')}, f AS (SELECT id, list_filter(occurrences, lambda o: o.start_at >= {NOW_SQL} AND o.start_at <> headline_at) AS l FROM groups)"
        " SELECT id, coalesce(array_to_string(list_transform(l[1:8], lambda o: o.id::VARCHAR), ','), '') AS further, greatest(0, len(l) - 8)::INTEGER AS more FROM f"
    )
)
def further_occurrences(spark, d):
    out = search.further_occurrences(_groups(spark, d), NOW)
    return out.select("id", F.array_join(F.transform("further", lambda o: o["id"].cast("string")), ",").alias("further"), "more")


@query(
    with_ev(
        "SELECT count(*) AS total, count(*) FILTER (archived_at IS NULL) AS active, count(*) FILTER (archived_at IS NULL AND (lat IS NULL OR lon IS NULL)) AS no_coords,"
        " count(*) FILTER (archived_at IS NULL AND coalesce(category, '') = '') AS no_category, count(*) FILTER (archived_at IS NULL AND start_at IS NULL) AS no_date,"
        " count(*) FILTER (archived_at IS NULL AND coalesce(short_description, '') = '') AS no_desc, round(avg(quality_score) FILTER (archived_at IS NULL), 3) AS avg_quality,"
        " count(*) FILTER (archived_at IS NOT NULL) AS archived FROM ev"
    )
)
def admin_stats(spark, d):
    return admin.stats(ev(spark, d))


@query(with_ev("SELECT coalesce(source_name, 'Unbekannt') AS name, count(*) AS n FROM ev WHERE archived_at IS NULL GROUP BY 1"))
def admin_by_source(spark, d):
    return admin.count_by(ev(spark, d), "source_name", "Unbekannt")


@query(with_ev("SELECT coalesce(category, 'Keine') AS name, count(*) AS n FROM ev WHERE archived_at IS NULL GROUP BY 1"))
def admin_by_category(spark, d):
    return admin.count_by(ev(spark, d), "category", "Keine")


PROBLEM = "id, title, source_name, source_url, start_at, category, venue_name, short_description, lat, lon, quality_score, is_permanent_offer"


def _register_problems() -> None:
    where = {"no_coords": "lat IS NULL OR lon IS NULL", "no_date": "start_at IS NULL", "no_category": "coalesce(category, '') = ''", "no_desc": "coalesce(short_description, '') = ''"}
    for kind, w in where.items():
        sql = with_ev(f", described AS (SELECT * REPLACE (CASE id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE short_description END AS short_description) FROM ev) SELECT {PROBLEM} FROM described WHERE archived_at IS NULL AND ({w}) ORDER BY id DESC LIMIT 50")
        query(sql, f"problems_{kind}")(lambda spark, d, kind=kind: admin.problems(_some_described(spark, d), kind).select(*PROBLEM.split(", ")))


def _some_described(spark, d):
    """Events, two of seven without a description."""
    nth = F.col("id") % 7
    return ev(spark, d).withColumn("short_description", F.when(nth == 1, F.lit("")).when(nth != 0, F.col("short_description")))


_register_problems()

RUNS_SQL = (
    "runs AS (SELECT event_id AS id, 'source ' || (user_id % 23)::VARCHAR AS source_name, ts AS started_at, ts + INTERVAL 5 MINUTE AS finished_at,"
    " CASE event_type WHEN 'click' THEN 'error' WHEN 'error' THEN 'error' ELSE 'success' END AS status, floor(value)::INTEGER % 7 AS items_found FROM events)"
)


def runs(spark, d):
    """Crawl runs derived from the event stream table."""
    e = table(spark, d, "events")
    return e.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("source "), (F.col("user_id") % 23).cast("string")).alias("source_name"),
        F.col("ts").alias("started_at"),
        (F.col("ts") + F.expr("INTERVAL 5 MINUTES")).alias("finished_at"),
        F.when(F.col("event_type").isin("click", "error"), "error").otherwise("success").alias("status"),
        (F.floor("value").cast("int") % 7).alias("items_found"),
    )


RUN = "id, source_name, started_at, status, items_found"


@query(f"WITH {RUNS_SQL} SELECT {RUN} FROM runs ORDER BY started_at DESC, id DESC LIMIT 30")
def crawl_recent(spark, d):
    return admin.recent_runs(runs(spark, d)).select(*RUN.split(", "))


@query(f"WITH {RUNS_SQL} SELECT {RUN}, rn FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, id DESC)::INTEGER AS rn FROM runs) WHERE rn <= 5")
def crawl_last_runs(spark, d):
    return admin.last_runs(runs(spark, d)).select(*RUN.split(", "), "rn")


@query(
    f"WITH {RUNS_SQL}, r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY started_at DESC, id DESC) AS rn FROM runs) WHERE rn <= 5), top AS (SELECT max(started_at) AS now FROM runs),"
    " l AS (SELECT source_name, max(status) FILTER (rn = 1) AS last_status, max(items_found) FILTER (rn = 1) AS last_found, max(finished_at) FILTER (status = 'success') AS ok_at,"
    " string_agg(coalesce(items_found, 0)::VARCHAR, ',' ORDER BY rn) AS trend FROM r GROUP BY 1),"
    " b AS (SELECT 'source ' || range::VARCHAR AS source_name, l.* EXCLUDE (source_name), CASE WHEN last_status = 'error' THEN 'red' WHEN last_status = 'success' AND coalesce(last_found, 0) = 0 THEN 'yellow' WHEN last_status = 'success' THEN 'green' ELSE 'unknown' END AS base"
    " FROM range(25) LEFT JOIN l ON l.source_name = 'source ' || range::VARCHAR)"
    " SELECT source_name, CASE WHEN base IN ('green', 'yellow') AND ok_at < TIMESTAMP '2024-02-01' - INTERVAL 48 HOUR THEN 'stale' ELSE base END AS health, last_status, last_found, coalesce(trend, '') AS trend FROM b"
)
def source_health(spark, d):
    names = spark.range(25).select(F.concat(F.lit("source "), F.col("id").cast("string")).alias("source_name"))
    active = ev(spark, d)
    out = admin.sources_health(names, runs(spark, d), active, datetime(2024, 2, 1))
    return out.select("source_name", "health", "last_status", "last_found", F.array_join(F.transform("trend", lambda x: x.cast("string")), ",").alias("trend"))


_REGISTRY = "(VALUES " + ", ".join(f"({k}, '{s.name}', '{s.kind}')" for k, s in enumerate(SOURCES)) + ") t(k, source_name, source_type)"


@query(f"SELECT source_name, source_type, count(*) AS n, min(p_partkey) AS first FROM part JOIN {_REGISTRY} ON p_partkey % {len(SOURCES) + 3} = k GROUP BY 1, 2")
def source_registry(spark, d):
    """Parts by the registered source that their number names; some name none."""
    names = F.array(*[F.lit(s.name) for s in SOURCES])
    named = table(spark, d, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % (len(SOURCES) + 3)).cast("int")).alias("source_name"))
    return named.join(F.broadcast(sources(spark)), "source_name").groupBy("source_name", "source_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))  # a row per source


def _docs(spark, d):
    """The whole text as a line."""
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), "\n", " ").alias("line"), "text", "source")


LINE = "line AS (SELECT doc_id, replace(coalesce(text, ''), chr(10), ' ') AS line, text, source FROM documents)"
_INV = text.INVISIBLE


def _norm_sql(stop: list[str], column: str = "line") -> str:
    words = ", ".join(f"'{w}'" for w in stop)
    return f"array_to_string(list_filter(string_split(regexp_replace(lower(regexp_replace({column}, '{_INV}', '', 'g')), '[^\\p{{L}}\\p{{N}}_ ]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN ({words})), ' ')"


@query(f"WITH {LINE} SELECT doc_id, nullif(trim(regexp_replace(regexp_replace(line, '{_INV}', '', 'g'), '\\s+', ' ', 'g')), '') AS title FROM line")
def title_sanitize(spark, d):
    return _docs(spark, d).select("doc_id", text.sanitize_title(F.col("line")).alias("title"))


@query(f"WITH {LINE} SELECT doc_id, {_norm_sql(text.GROUP_STOPWORDS)} AS grouping_key, {_norm_sql(text.DEDUP_STOPWORDS)} AS dedup_key FROM line")
def title_norm(spark, d):
    return _docs(spark, d).select("doc_id", text.group_title(F.col("line")).alias("grouping_key"), text.dedup_title(F.col("line")).alias("dedup_key"))


@query(
    f"WITH {LINE}, w AS (SELECT doc_id, list_distinct(list_filter(string_split({_norm_sql(text.DEDUP_STOPWORDS)}, ' '), lambda x: x <> '')) AS w FROM line),"
    " p AS (SELECT doc_id, w, lead(w) OVER (ORDER BY doc_id) AS v FROM w)"
    " SELECT doc_id, CASE WHEN len(w) = 0 OR len(v) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(w, v))::DOUBLE / len(list_distinct(list_concat(w, v))), 6) END AS similarity FROM p WHERE v IS NOT NULL"
)
def title_jaccard(spark, d):
    """Similarity of neighbouring titles; ids are consecutive, so the neighbour is an equi-join."""
    w = _docs(spark, d).select("doc_id", text.title_tokens(F.col("line")).alias("w"))
    other = w.select((F.col("doc_id") - 1).alias("doc_id"), F.col("w").alias("v"))
    return w.join(other, "doc_id").select("doc_id", F.round(text.jaccard(F.col("w"), F.col("v")), 6).alias("similarity"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN regexp_replace(substr(text, 1, 500), '\\s+$', '') ELSE text END AS clamped FROM documents")
def clamp(spark, d):
    return table(spark, d, "documents").select("doc_id", text.clamp(F.col("text"), 500).alias("clamped"))


BROKEN = "CASE doc_id % 3 WHEN 0 THEN 'TAGESTIPP22Mo, 01. Jun | 19:00 ' WHEN 1 THEN '5Übermorgen, 12. März | 9:30' ELSE '' END || coalesce(text, '')"


@query(f"SELECT doc_id, regexp_matches({BROKEN}, '" + text.BROKEN_TITLE.replace("(?iu)", "(?i)") + "') AS broken FROM documents")
def broken_titles(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_broken_title(F.concat(F.expr(BROKEN.rsplit(" || ", 1)[0]), F.coalesce("text", F.lit("")))).alias("broken"))


@query("SELECT doc_id, substr(trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')), 1, 500) AS key FROM documents")
def cache_key(spark, d):
    return table(spark, d, "documents").select("doc_id", text.cache_key(F.col("text")).alias("key"))


@query("SELECT c_custkey, trim(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END || '|' || CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment ELSE '' END || '|' || CASE WHEN c_custkey % 2 = 0 THEN 'Bochum' ELSE 'Essen' END, '|') AS query FROM customer")
def geocode_query(spark, d):
    k = F.col("c_custkey")
    q = text.geocode_query(F.when(k % 3 != 0, F.col("c_name")), F.when(k % 5 == 0, F.col("c_mktsegment")), F.when(k % 2 == 0, "Bochum"), "Essen")
    return table(spark, d, "customer").select("c_custkey", q.alias("query"))


@query("SELECT o_orderkey, substr(md5(o_orderpriority || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S')), 1, 16) AS canonical_id FROM orders")
def canonical_id(spark, d):
    key = F.concat("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss"))
    return table(spark, d, "orders").select("o_orderkey", text.canonical_id(key).alias("canonical_id"))


def _category_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{classify._quoted(words)}') THEN '{name}'" for name, words in classify.CATEGORY_KEYWORDS.items()) + " END"


@query(f"SELECT doc_id, {_category_sql('''lower(coalesce(text, ''))''')} AS category FROM documents")
def classify_category(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.category(F.lower(F.coalesce("text", F.lit("")))).alias("category"))


@query(
    "WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS v FROM documents)"
    f", k AS (SELECT *, regexp_matches(t, '{classify._quoted(classify.INDOOR_KEYWORDS)}') AS i, regexp_matches(t, '{classify._quoted(classify.OUTDOOR_KEYWORDS)}') AS o FROM t)"
    " SELECT doc_id, CASE WHEN contains(v, 'zollverein') OR contains(t, 'museum') THEN 'indoor' WHEN contains(v, 'grugapark') THEN 'outdoor' WHEN i AND o THEN 'both' WHEN o THEN 'outdoor' WHEN i THEN 'indoor' END AS setting FROM k"
)
def classify_setting(spark, d):
    return table(spark, d, "documents").select("doc_id", classify.indoor_outdoor(F.lower(F.coalesce("text", F.lit(""))), F.col("source")).alias("setting"))


@query(with_ev(f", t AS (SELECT *, lower(coalesce(title, '')) || ' ' || lower(coalesce(short_description, '')) || ' ' || lower(coalesce(venue_name, '')) AS t FROM ev) SELECT id, CASE WHEN coalesce(category, '') <> '' THEN category ELSE {_category_sql('t')} END AS category, kids_suitable FROM t"))
def set_if_missing(spark, d):
    return classify.classify(ev(spark, d)).select("id", "category", "kids_suitable")


@query(with_ev("SELECT id, distance_km, travel_time_minutes FROM ev"))
def haversine(spark, d):
    e = ev(spark, d).drop("distance_km", "travel_time_minutes")
    km = geo.distance_km(F.col("lat"), F.col("lon"))
    return e.select("id", km.alias("distance_km"), geo.travel_minutes(km).alias("travel_time_minutes"))


@query(with_ev("SELECT id, quality_score FROM ev"))
def quality_score(spark, d):
    return ev(spark, d).select("id", geo.quality_score().alias("quality_score"))


HINT_ARGS = "(event_id % 101)::INTEGER AS rain, (event_id % 100)::INTEGER AS code, (event_id % 87) / 2.0::DOUBLE - 6 AS warmest"


@query(
    f"WITH e AS (SELECT event_id, {HINT_ARGS} FROM events), t AS (SELECT *, round_even(warmest, 0)::INTEGER::VARCHAR AS g FROM e)"
    " SELECT event_id, CASE WHEN code >= 95 THEN 'Gewitter erwartet - Indoor sinnvoll' WHEN code >= 61 OR rain >= 70 THEN 'Regen wahrscheinlich - Indoor sinnvoll' WHEN code >= 51 OR rain >= 40 THEN 'Wetterabhängig - Regenschirm mitnehmen'"
    " WHEN warmest >= 28 THEN 'Warm (' || g || '°C) - Sonnenschutz empfohlen' WHEN warmest <= 2 THEN 'Kalt (' || g || '°C) - Warm anziehen' WHEN code <= 1 THEN 'Schönes Wetter (' || g || '°C) - Gut für Outdoor' ELSE g || '°C - Gut bei jedem Wetter' END AS hint,"
    " CASE WHEN code >= 95 THEN 'thunder' WHEN code >= 71 THEN 'snow' WHEN code >= 61 THEN 'rain' WHEN code >= 51 THEN 'drizzle' WHEN code <= 1 THEN 'sun' ELSE 'cloud' END AS icon FROM t"
)
def weather_hint(spark, d):
    k = F.col("event_id")
    rain, code, warmest = (k % 101).cast("int"), (k % 100).cast("int"), (k % 87) / F.lit(2.0) - 6
    return table(spark, d, "events").select("event_id", F.regexp_replace(weather.hint(rain, code, warmest), r"-0°", "0°").alias("hint"), weather.icon(code).alias("icon"))


@query(
    with_ev(
        ", w AS (SELECT range::DATE AS day, 'Hinweis ' || strftime(range, '%d') AS hint FROM range(TIMESTAMP '1998-05-30', TIMESTAMP '1998-06-30', INTERVAL 1 DAY) WHERE extract(day FROM range) % 3 <> 0)"
        " SELECT id, CASE WHEN start_at::DATE - DATE '1998-06-01' BETWEEN 0 AND 7 THEN hint END AS weather_note FROM ev LEFT JOIN w ON start_at::DATE = day"
    )
)
def weather_join(spark, d):
    days = spark.sql("SELECT explode(sequence(DATE '1998-05-30', DATE '1998-06-29')) AS target_date").where("day(target_date) % 3 <> 0")
    days = days.withColumn("hint", F.concat(F.lit("Hinweis "), F.date_format("target_date", "dd")))
    e = ev(spark, d).withColumn("weather_note", F.lit(None).cast("string"))
    return weather.with_weather(e, days, date(1998, 6, 1)).select("id", "weather_note")


@query("SELECT event_id, (timezone('Europe/Berlin', timezone('UTC', ts))) AS local FROM events")
def berlin_time(spark, d):
    return table(spark, d, "events").select("event_id", dates.berlin_from_utc(F.col("ts")).alias("local"))


@query("SELECT o_orderkey, o_orderdate AS named, o_orderdate + INTERVAL 18 HOUR + INTERVAL 30 MINUTE AS digits, NULL::TIMESTAMP AS wrong FROM orders")
def german_dates(spark, d):
    names = ["Januar", "Februar", "März", "April", "Mai", "Juni", "Juli", "August", "September", "Oktober", "November", "Dezember"]
    day, month, year = F.date_format("o_orderdate", "d"), F.month("o_orderdate"), F.date_format("o_orderdate", "yyyy")
    named = F.concat(day, F.lit(". "), F.element_at(F.array(*map(F.lit, names)), month), F.lit(" "), year)
    digits = F.concat(day, F.lit("."), month.cast("string"), F.lit("."), year, F.lit(" 18:30 Uhr"))
    this = F.lit(2000)
    return table(spark, d, "orders").select(
        "o_orderkey",
        dates.parse_german(named, this).alias("named"),
        dates.parse_german(digits, this).alias("digits"),
        dates.parse_german(F.concat(F.lit("31. Februar "), year), this).alias("wrong"),
    )


@query(
    "SELECT o_orderkey, (DATE '1998-06-01' - o_orderdate::DATE) * -1 BETWEEN 0 AND 7 AS in_forecast, o_orderdate + to_hours((o_orderkey % 40)::INTEGER) > o_orderdate + INTERVAL 24 HOUR AS late,"
    f" {NOW_SQL} - (TIMESTAMP '1998-06-01' - to_hours((o_orderkey % 9000)::INTEGER)) < CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 180 DAY ELSE INTERVAL 14 DAY END AS geocode_fresh,"
    f" {NOW_SQL} - (TIMESTAMP '1998-06-01 12:00:00' - to_hours((o_orderkey % 30)::INTEGER)) < CASE WHEN o_orderkey % 2 = 0 THEN INTERVAL 3 HOUR ELSE INTERVAL 24 HOUR END AS weather_fresh FROM orders"
)
def ttl_freshness(spark, d):
    k = F.col("o_orderkey")
    hours = lambda n, at: F.timestamp_add("HOUR", -(k % n).cast("int"), F.lit(at).cast("timestamp_ntz"))
    now = F.lit(NOW).cast("timestamp_ntz")
    return table(spark, d, "orders").select(
        "o_orderkey",
        weather.within_forecast(F.col("o_orderdate"), F.lit(date(1998, 6, 1))).alias("in_forecast"),
        (k % 40 > 24).alias("late"),
        weather.geocode_fresh(hours(9000, "1998-06-01 00:00:00"), F.when(k % 2 == 0, F.lit(1.0)), now).alias("geocode_fresh"),
        weather.weather_fresh(hours(30, "1998-06-01 12:00:00"), F.when(k % 2 == 0, F.lit(date(1998, 6, 1))).otherwise(F.lit(date(1998, 6, 2))), now).alias("weather_fresh"),
    )


_VENUES = ", ".join(f"({i}, '{v[0]}', {v[1]}::DOUBLE)" for i, v in enumerate(KNOWN_VENUES))
_PLACE = "CASE c_custkey % 4 WHEN 0 THEN c_name || ' Grugapark' WHEN 1 THEN 'Halle 8 Zollverein' WHEN 2 THEN 'GREND ' || c_mktsegment ELSE c_name END"


@query(f"WITH v(ord, k, lat) AS (VALUES {_VENUES}), c AS (SELECT c_custkey, lower({_PLACE}) || ' ' AS t FROM customer) SELECT c_custkey, (SELECT arg_min(k, ord) FROM v WHERE contains(t, k)) AS keyword, (SELECT arg_min(lat, ord) FROM v WHERE contains(t, k)) AS lat FROM c")
def known_venue_lookup(spark, d):
    found = table(spark, d, "customer").select("c_custkey", geo.known_venue(F.expr(_PLACE), F.lit(None).cast("string")).alias("v"))
    return found.select("c_custkey", F.col("v.keyword").alias("keyword"), F.col("v.lat").alias("lat"))


_ADDRESS = "CASE c_custkey % 6 WHEN 0 THEN 'Weg 1, 45127 Essen' WHEN 1 THEN 'Weg 2, 44787 Bochum' WHEN 2 THEN 'Weg 3, 45999 Essen-Süd' WHEN 3 THEN 'Weg 4, 45468 Mülheim' WHEN 4 THEN 'Weg 5, Essen' ELSE c_name END"
_CODES = ", ".join(f"'{c}'" for c in geo.CITY_CODES)


@query(
    f"WITH a AS (SELECT c_custkey, {_ADDRESS} AS a FROM customer), p AS (SELECT *, regexp_extract(a, '\\b([0-9]{{5}})\\b', 1) AS code FROM a)"
    f" SELECT c_custkey, CASE WHEN code = '' THEN true WHEN code IN ({_CODES}) THEN true ELSE code LIKE '45%' AND regexp_matches(a, '(?i)\\bEssen\\b') END AS in_city, nullif(trim(regexp_extract(a, '[0-9]{{5}}\\s+([^,]+)$', 1)), '') AS city FROM p"
)
def city_address(spark, d):
    a = F.expr(_ADDRESS)
    return table(spark, d, "customer").select("c_custkey", geo.in_city(a).alias("in_city"), geo.city_of(a).alias("city"))


CACHE_SQL = "cache AS (SELECT * EXCLUDE (rn) FROM (SELECT 'place ' || (user_id % 50)::VARCHAR AS query, CASE WHEN event_type <> 'click' THEN value END AS lat, ts AS fetched_at, row_number() OVER (PARTITION BY user_id % 50 ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1)"


@query(
    f"WITH {CACHE_SQL}, c AS (SELECT c_custkey, c_custkey % 5 = 0 AS own, c_custkey % 7 = 0 AS known, 'place ' || (c_custkey % 60)::VARCHAR || '||essen' AS key FROM customer)"
    " SELECT c_custkey, CASE WHEN own THEN 1.5::DOUBLE WHEN known THEN 51.4293::DOUBLE ELSE lat END AS lat, CASE WHEN own THEN 'own' WHEN known THEN 'venue' WHEN lat IS NOT NULL THEN 'cache' WHEN query IS NOT NULL THEN 'miss' END AS geocoded_by"
    " FROM c LEFT JOIN cache ON query || '||essen' = key AND TIMESTAMP '2024-02-05' - fetched_at < CASE WHEN lat IS NOT NULL THEN INTERVAL 180 DAY ELSE INTERVAL 14 DAY END"
)
def cache_join(spark, d):
    """Places of customers: their own, that of a known venue, or what the cache says."""
    e = table(spark, d, "events").select(F.concat(F.lit("place "), (F.col("user_id") % 50).cast("string"), F.lit("||essen")).alias("query"), F.when(F.col("event_type") != "click", F.col("value")).alias("lat"), F.col("ts").alias("fetched_at"), "event_id")
    newest = e.groupBy("query").agg(F.max(F.struct("fetched_at", "event_id", "lat")).alias("m")).select("query", "m.lat", F.col("m.lat").alias("lon"), "m.fetched_at")
    k = F.col("c_custkey")
    c = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("Place  "), (k % 60).cast("string")).alias("venue_name"), F.when(k % 7 == 0, "Fest im Grugapark").otherwise("Fest").alias("title"), F.lit(None).cast("string").alias("address_text"), F.lit("Essen").alias("city"),
        F.when(k % 5 == 0, F.lit(1.5)).alias("lat"), F.when(k % 5 == 0, F.lit(1.5)).alias("lon"),
    )
    return lifecycle.geocode(c, newest, "Essen", datetime(2024, 2, 5)).select("c_custkey", "lat", "geocoded_by")


PAIRS_SQL = (
    "pairs AS (SELECT a.id AS a_id, b.id AS b_id, len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) AS similarity FROM {a} a JOIN {b} b"
    " ON abs(epoch(a.start_at) - epoch(b.start_at)) <= 43200 AND a.source_name IS DISTINCT FROM b.source_name AND len(a.words) > 0 AND len(b.words) > 0"
    " WHERE len(list_intersect(a.words, b.words))::DOUBLE / len(list_distinct(list_concat(a.words, b.words))) >= 0.6)"
)


@query(
    with_ev(
        ", act AS (SELECT * FROM ev WHERE archived_at IS NULL AND start_at IS NOT NULL), "
        + PAIRS_SQL.format(a="act", b="act")
        + " SELECT a_id, b_id, round(similarity, 6) AS similarity FROM pairs JOIN act a ON a.id = a_id JOIN act b ON b.id = b_id WHERE a.start_at < b.start_at OR (a.start_at = b.start_at AND a_id < b_id)"
    )
)
def retro_pairs(spark, d):
    return matching.retro_pairs(ev(spark, d)).select("a_id", "b_id", F.round("similarity", 6).alias("similarity"))


@query(with_ev(", old AS (SELECT * FROM ev WHERE id % 2 = 0 AND archived_at IS NULL), new AS (SELECT * FROM ev WHERE id % 2 = 1), " + PAIRS_SQL.format(a="new", b="old").replace("IS DISTINCT FROM", "<>") + " SELECT new.id AS a_id, min(b_id) AS match_id FROM new LEFT JOIN pairs ON new.id = a_id GROUP BY 1"))
def dup_candidates(spark, d):
    e = ev(spark, d)
    return matching.cross_source_duplicate(e.where("id % 2 = 1"), e.where("id % 2 = 0"))


RETRO_SQL = with_ev(
    ", act AS (SELECT * FROM ev WHERE archived_at IS NULL AND start_at IS NOT NULL), "
    + PAIRS_SQL.format(a="act", b="act")
    + """, p AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY a.start_at, a.id, b.start_at, b.id) AS k, a.id AS a, b.id AS b, a.source_name AS a_source, b.source_name AS b_source,
    a.sources_list AS a_list, b.sources_list AS b_list, a.source_count AS a_count, b.source_count AS b_count
  FROM pairs JOIN act a ON a.id = a_id JOIN act b ON b.id = b_id WHERE a.start_at < b.start_at OR (a.start_at = b.start_at AND a_id < b_id)
), r(k, gone, lists) AS (
  SELECT 0::BIGINT, []::BIGINT[], MAP {}::MAP(BIGINT, VARCHAR[])
  UNION ALL
  SELECT k, CASE WHEN skip THEN gone ELSE list_append(gone, CASE WHEN first THEN b ELSE a END) END,
    CASE WHEN skip THEN lists ELSE map_concat(lists, MAP {CASE WHEN first THEN a ELSE b END: list_concat(own, CASE WHEN list_contains(own, other) THEN [] ELSE [other] END)}) END
  FROM (SELECT *, CASE WHEN list_contains(had, name) THEN had ELSE list_concat([name], had) END AS own FROM (
    SELECT p.*, r.gone, r.lists, list_contains(gone, a) OR list_contains(gone, b) AS skip, coalesce(len(lists[a]), a_count) >= coalesce(len(lists[b]), b_count) AS first,
      CASE WHEN first THEN a_source ELSE b_source END AS name, CASE WHEN first THEN b_source ELSE a_source END AS other,
      CASE WHEN first THEN coalesce(lists[a], string_split(a_list, ',')) ELSE coalesce(lists[b], string_split(b_list, ',')) END AS had
    FROM r JOIN p ON p.k = r.k + 1))
), ended AS (SELECT gone, lists FROM r ORDER BY k DESC LIMIT 1)
SELECT id, coalesce(len(lists[id]), source_count)::INTEGER AS source_count, coalesce(array_to_string(lists[id], ','), sources_list) AS sources_list FROM ev, ended WHERE NOT list_contains(gone, id)
"""
).replace("WITH", "WITH RECURSIVE", 1)


@query(RETRO_SQL)
def retro_merge(spark, d):
    return matching.retro_merge(ev(spark, d)).select("id", "source_count", "sources_list")


@query(with_ev("SELECT canonical_id, min(id) AS id FROM (SELECT substr(canonical_id, 1, 2) AS canonical_id, id FROM ev WHERE title <> '') GROUP BY 1"))
def batch_dedup(spark, d):
    e = ev(spark, d).withColumn("canonical_id", F.substring("canonical_id", 1, 2))
    return matching.first_of_batch(e, "id").select("canonical_id", "id")


#: Sources in the order in which their batches are merged.
BATCHES = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


def _sync(spark, d):
    e = ev(spark, d)
    # two of three events are known; every source brings one of three again and the rest anew, some without a title
    state = e.where("id % 3 <> 0")
    batch = e.where("id % 3 <> 1").withColumn("pos", F.col("id")).withColumn("title", F.when(F.col("id") % 15 != 0, F.col("title")))
    batch = batch.withColumns({"price_text": F.when(F.col("id") % 2 == 0, F.lit("neu")), "venue_name": F.concat(F.lit(" "), F.col("venue_name"), F.lit("  Saal"))})
    return merging.upsert_all(state, batch, BATCHES, NOW)


def _sync_sql() -> str:
    """The sources one after the other: of source k the fresh rows ``fk``, their matches ``mk``, the events ``ek`` made of them, and what is known then, ``kk``."""
    out = [
        ", state AS (SELECT * FROM ev WHERE id % 3 <> 0), batch AS (SELECT *, CASE WHEN id % 15 <> 0 THEN title END AS t FROM ev WHERE id % 3 <> 1), fresh AS (SELECT * FROM batch WHERE id % 3 = 0 AND t IS NOT NULL),"
        " k0 AS (SELECT id, start_at, source_name, words FROM state WHERE archived_at IS NULL), t0 AS (SELECT max(id) AS top FROM state)"
    ]
    for k, name in enumerate(BATCHES, 1):
        out += [
            f"f{k} AS (SELECT * FROM fresh WHERE source_name = '{name}')",
            PAIRS_SQL.format(a=f"f{k}", b=f"k{k - 1}").replace("pairs AS", f"p{k} AS MATERIALIZED", 1),
            f"m{k} AS (SELECT id, match_id, row_number() OVER (ORDER BY id) AS n FROM (SELECT f.id, min(b_id) AS match_id FROM f{k} f LEFT JOIN p{k} ON a_id = f.id GROUP BY 1))",
            f"e{k} AS (SELECT m.id AS old_id, top + n AS id FROM m{k} m, t{k - 1} WHERE match_id IS NULL)",
            f"t{k} AS (SELECT greatest(top, (SELECT max(id) FROM e{k})) AS top FROM t{k - 1})",
            f"k{k} AS (SELECT * FROM k{k - 1} UNION ALL SELECT e.id, start_at, source_name, words FROM e{k} e JOIN f{k} f ON f.id = e.old_id WHERE archived_at IS NULL)",
        ]
    each = lambda sql: " UNION ALL ".join(sql.format(k=k, name=name) for k, name in enumerate(BATCHES, 1))
    out += [
        f"made AS ({each('SELECT * FROM e{k}')})",
        f"met AS ({each('SELECT DISTINCT match_id, {k} AS k, ' + chr(39) + '{name}' + chr(39) + ' AS name FROM m{k} WHERE match_id IS NOT NULL')})",
        "lists AS (SELECT match_id, string_agg(name, ',' ORDER BY k) AS others, count(*) AS n FROM met GROUP BY 1)",
    ]
    return ", ".join(out)


SYNC_SQL = _sync_sql()


@query(
    with_ev(
        SYNC_SQL + " SELECT b.source_name, count(*) AS found, count(made.id) AS created, count(*) FILTER (b.id % 3 = 2) AS updated, any_value(coalesce(merged, 0)) AS merged"
        " FROM batch b LEFT JOIN made ON made.old_id = b.id LEFT JOIN (SELECT name, count(*) AS merged FROM met GROUP BY 1) x ON x.name = b.source_name GROUP BY 1"
    )
)
def sync_stats(spark, d):
    """What the merge of all sources did, by source."""
    return merging.stats_by_source(_sync(spark, d).outcome)


@query(
    with_ev(
        SYNC_SQL
        + ", everything AS (SELECT id, canonical_id, CASE WHEN id % 3 = 2 AND id % 2 = 0 THEN 'neu' ELSE price_text END AS price_text, CASE WHEN id % 3 = 2 THEN venue_name || ' Saal' ELSE venue_name END AS venue_name, sources_list, source_count FROM state UNION ALL"
        " SELECT made.id, canonical_id, CASE WHEN old_id % 2 = 0 THEN 'neu' END, venue_name || ' Saal', source_name, 1 FROM made JOIN fresh ON fresh.id = old_id)"
        " SELECT id, canonical_id, price_text, venue_name, sources_list || coalesce(',' || others, '') AS sources_list, (CASE WHEN n IS NOT NULL THEN 1 + n ELSE source_count END)::INTEGER AS source_count FROM everything LEFT JOIN lists ON match_id = id"
    )
)
def upsert_merge(spark, d):
    """The batches of all sources, each matched against what those before it brought."""
    return _sync(spark, d).state.select("id", "canonical_id", "price_text", "venue_name", "sources_list", "source_count")


@query(with_ev(f"SELECT id, CASE WHEN archived_at IS NULL AND start_at < {NOW_SQL} AND NOT is_permanent_offer THEN {NOW_SQL} ELSE archived_at END AS archived_at FROM ev"))
def archive_past(spark, d):
    return lifecycle.archive_past(ev(spark, d), NOW).select("id", "archived_at")


@query(with_ev(f"SELECT id FROM ev WHERE archived_at IS NULL OR archived_at >= {NOW_SQL} - INTERVAL 1200 DAY"))
def purge_archived(spark, d):
    return lifecycle.purge_archived(ev(spark, d), NOW, 1200).select("id")


@query(with_ev("SELECT id FROM ev WHERE archived_at IS NULL AND (lat IS NULL OR lon IS NULL) ORDER BY id LIMIT 500"))
def pending_geocode(spark, d):
    return lifecycle.pending_geocode(ev(spark, d)).select("id")


@query(
    "WITH l AS (SELECT doc_id, p, lines[p] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS p FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)))"
    " SELECT doc_id, (p - 1)::INTEGER AS pos, last_value(CASE WHEN length(line) <= 40 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY p) AS header, lead(length(line), 1) OVER (PARTITION BY doc_id ORDER BY p)::INTEGER AS next_length FROM l"
)
def text_carry_forward(spark, d):
    from cityfeed.sources.lines import carry_forward, numbered_lines, look

    lines = numbered_lines(table(spark, d, "documents"), "doc_id", "text")
    lines = carry_forward(lines, "doc_id", F.when(F.length("line") <= 40, F.col("line")), "header")
    return look(lines, "doc_id", F.length("line"), 1, "next_length").select("doc_id", "pos", "header", "next_length")


@query("SELECT page_id, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || '/robots.txt' AS robots FROM pages")
def url_robots(spark, d):
    return table(spark, d, "pages").select("page_id", text.robots_url(F.col("url")).alias("robots"))


@query(
    "WITH a AS (SELECT page_id, unnest(l) AS tag, unnest(range(len(l))) AS pos FROM (SELECT page_id, regexp_extract_all(html, '<a href=\"[^\"]*\">[^<]*</a>') AS l FROM pages)),"
    " u AS (SELECT page_id, pos, regexp_extract(tag, 'href=\"([^\"]*)\"', 1) AS href, regexp_extract(tag, '>([^<]*)<', 1) AS label FROM a)"
    " SELECT page_id, pos::INTEGER AS pos, replace(replace(replace(href, '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS href, trim(replace(replace(replace(label, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')) AS label FROM u"
)
def html_links(spark, d):
    from cityfeed.sources.html import links

    return links(table(spark, d, "pages"))


@query("SELECT page_id, replace(replace(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&') AS title FROM pages")
def html_titles(spark, d):
    from cityfeed.sources.html import titles

    return titles(table(spark, d, "pages"))


@query("SELECT event_id, (props->>'$.k')::INTEGER AS k FROM events")
def json_props(spark, d):
    props = F.try_parse_json("props")
    return table(spark, d, "events").select("event_id", F.try_variant_get(props, "$.k", "int").alias("k"))


@query(
    with_ev(
        f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')} SELECT canonical_id, id, title, quality_score, lat, len(occurrences)::INTEGER AS n, occurrences[1].id AS first_id, price_text IS NULL AS no_price,"
        " 'address_text,archived_at,canonical_id,category,distance_km,id,indoor_outdoor,is_permanent_offer,kids_suitable,lat,lon,occurrences,price_text,quality_score,short_description,source_count,source_name,source_url,sources_list,start_at,title,travel_time_minutes,venue_name' AS keys FROM groups"
    )
)
def snapshot_json(spark, d):
    """The snapshot, read back from its lines."""
    from cityfeed.sources.snapshot import snapshot

    e = F.from_json("json", "id long, title string, quality_score double, lat double, occurrences array<struct<id:long>>, price_text string")
    out = snapshot(search.feed(ev(spark, d), NOW), NOW).select("canonical_id", e.alias("e"), F.array_join(F.json_object_keys("json"), ",").alias("keys"))
    return out.select("canonical_id", "e.id", "e.title", "e.quality_score", "e.lat", F.size("e.occurrences").alias("n"), F.get("e.occurrences", F.lit(0))["id"].alias("first_id"), F.col("e.price_text").isNull().alias("no_price"), "keys")


@query(
    with_ev(f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')} SELECT count(*) AS events, sum(n_occurrences)::BIGINT AS occurrences FROM groups")
)
def snapshot_counts(spark, d):
    return _groups(spark, d).agg(F.count("*").alias("events"), F.sum("n_occurrences").alias("occurrences"))


@query("SELECT user_id, ts, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def stream_upsert(spark, d):
    """The newest event of each user, from files that arrive as a stream."""
    from cityfeed.streaming.upsert import upsert_stream

    return upsert_stream(spark, f"{d}/events.parquet", "user_id").select("user_id", "ts", "event_id")


@query(
    with_ev(
        ", img AS (SELECT p_partkey AS pos, p_name AS label, 'https://i/' || p_partkey::VARCHAR AS url FROM part),"
        " w AS (SELECT word, arg_min(url, pos) AS url FROM (SELECT pos, url, unnest(list_distinct(list_filter(string_split_regex(lower(label), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 4))) AS word FROM img) GROUP BY 1),"
        " a AS (SELECT id, unnest(ws) AS word, unnest(range(len(ws))) AS nth FROM (SELECT id, list_filter(string_split_regex(lower(title), '[^\\p{L}\\p{N}_]+'), lambda x: length(x) >= 5) AS ws FROM ev)),"
        " f AS (SELECT id, arg_min(url, nth) AS image_url FROM a JOIN w USING (word) GROUP BY 1) SELECT id, image_url FROM ev LEFT JOIN f USING (id)"
    )
)
def image_words(spark, d):
    from cityfeed.operators.enrich import attach_images

    images = table(spark, d, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"), F.concat(F.lit("https://i/"), F.col("p_partkey").cast("string")).alias("url"))
    return attach_images(ev(spark, d).withColumn("image_url", F.lit(None).cast("string")), images).select("id", "image_url")


@query(
    "WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS v, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS a FROM customer),"
    " q AS (SELECT id, 0 AS nth, v || ', ' || a AS query FROM c UNION ALL SELECT id, 1, v || ', Essen' FROM c UNION ALL SELECT id, 2, a || ', Essen' FROM c UNION ALL SELECT id, 3, v || ', Essen, Germany' FROM c),"
    " p AS (SELECT c_name || ', Essen' AS query, c_acctbal AS lat FROM customer WHERE c_custkey % 5 = 0 UNION ALL SELECT DISTINCT c_mktsegment || ', Essen', 1.0::DOUBLE FROM customer WHERE c_mktsegment < 'C')"
    " SELECT id, arg_min(query, nth) AS query, arg_min(lat, nth) AS lat FROM q JOIN p USING (query) GROUP BY id"
)
def geocode_ladder(spark, d):
    from cityfeed.operators.enrich import geocode_ladder as ladder

    c, k = table(spark, d, "customer"), F.col("c_custkey")
    e = c.select(k.alias("id"), F.when(k % 3 > 0, F.col("c_name")).alias("venue_name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("address_text"), F.lit(None).cast("string").alias("city"))
    by_name = c.where("c_custkey % 5 = 0").select(F.concat("c_name", F.lit(", Essen")).alias("query"), F.col("c_acctbal").alias("lat"))
    by_street = c.where("c_mktsegment < 'C'").select(F.concat("c_mktsegment", F.lit(", Essen")).alias("query"), F.lit(1.0).alias("lat")).distinct()
    places = by_name.union(by_street).withColumn("lon", F.col("lat"))
    return ladder(e, places, "Essen").select("id", "query", "lat")


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'allowed' WHEN 1 THEN 'error' ELSE CASE WHEN regexp_matches(url, '^[a-z]+://[^/]*/(de|fr)/') THEN 'disallowed' ELSE 'allowed' END END AS result FROM pages")
def robots_check(spark, d):
    from cityfeed.functions.robots import evaluate

    status = F.element_at(F.array(F.lit(404), F.lit(500), F.lit(200), F.lit(200)), (F.col("page_id") % 4 + 1).cast("int"))
    body = F.lit("User-agent: *\nDisallow: /de/\nDisallow: /fr/\n")
    return table(spark, d, "pages").select("page_id", evaluate(status, body, F.col("url"), "cityfeed")["result"].alias("result"))


@query(with_ev(f"SELECT id::VARCHAR AS page FROM ev WHERE {VISIBLE_SQL} UNION ALL SELECT '_'"))
def page_ids(spark, d):
    return search.page_ids(_groups(spark, d))


@query(
    f"WITH a AS (SELECT c_custkey AS id, {_ADDRESS} AS a FROM customer), d AS (SELECT * FROM a WHERE id % 3 <> 0), p AS (SELECT *, regexp_extract(a, '\\b([0-9]{{5}})\\b', 1) AS code FROM d)"
    f" SELECT a.id, CASE WHEN p.id IS NOT NULL THEN p.a END AS address_text, coalesce(nullif(trim(regexp_extract(p.a, '[0-9]{{5}}\\s+([^,]+)$', 1)), ''), 'Essen') AS city FROM a LEFT JOIN p USING (id)"
    f" WHERE p.id IS NULL OR code = '' OR code IN ({_CODES}) OR (code LIKE '45%' AND regexp_matches(p.a, '(?i)\\bEssen\\b'))"
)
def detail_addresses(spark, d):
    from cityfeed.operators.enrich import with_addresses

    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("https://d/"), F.col("c_custkey").cast("string")).alias("source_url"), F.expr(_ADDRESS).alias("address"))
    events = c.select("id", "source_url", F.lit(None).cast("string").alias("address_text"), F.lit("Essen").alias("city"))
    return with_addresses(events, c.where("id % 3 <> 0").select("source_url", "address")).select("id", "address_text", "city")


@query("SELECT user_id, list_sort(CASE WHEN list_contains(l, 3) THEN list_filter(l, lambda x: x <> 3) ELSE list_append(l, 3) END)::VARCHAR AS favorites FROM (SELECT user_id, list_distinct(list(event_id % 7)) AS l FROM events GROUP BY 1)")
def favorites_toggle(spark, d):
    from cityfeed.operators.enrich import toggle

    kept = table(spark, d, "events").groupBy("user_id").agg(F.collect_set(F.col("event_id") % 7).alias("l"))
    listed = F.array_join(F.transform(F.sort_array(toggle(F.col("l"), F.lit(3).cast("long"))), lambda x: x.cast("string")), ", ")
    return kept.select("user_id", F.concat(F.lit("["), listed, F.lit("]")).alias("favorites"))


from cityfeed.plans import kept, more, pages  # noqa: E402, F401  (they register theirs)
