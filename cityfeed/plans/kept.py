"""Queries of what is kept from run to run: places, answers, snapshots; clusters and bundles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cityfeed.operators import search
from cityfeed.plans.ev import NOW, NOW_SQL, VISIBLE_SQL, ev, grouped_sql, with_ev
from cityfeed.plans.registered import query
from cityfeed.sources.tables import dealt, shared_root, table

GROUPS_SQL = f", {grouped_sql(f'(SELECT * FROM ev WHERE {VISIBLE_SQL})')}"


def _lacking(spark, d):
    """An event without coordinates for every customer; one in seven stands in a known venue's title."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"), F.when(k % 7 == 0, "Fest im Grugapark").otherwise("Fest").alias("title"), F.when(k % 3 > 0, F.concat(F.lit("Place  "), (k % 60).cast("string"))).alias("venue_name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("address_text"),
        F.when(k % 4 == 0, F.lit("Bochum")).alias("city"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.when(k % 11 == 0, F.lit(NOW).cast("timestamp_ntz")).alias("archived_at"),
    )


def _answered(spark, d):
    """A cache of suppliers' places: found ones, misses, and misses that are too old."""
    k = F.col("s_suppkey")
    rows = table(spark, d, "supplier").where("s_suppkey < 60").select(F.concat(F.lit("place "), k.cast("string"), F.lit("||essen")).alias("query"), F.when(k % 3 > 0, F.col("s_acctbal")).alias("lat"), F.timestamp_add("DAY", -(k % 30).cast("int"), F.lit(NOW).cast("timestamp_ntz")).alias("fetched_at"))
    return rows.select("query", "lat", F.col("lat").alias("lon"), "fetched_at")


def _places(spark, d):
    """What the geocoder knows: some venues in a town, some streets."""
    k = F.col("s_suppkey")
    venues = table(spark, d, "supplier").where("s_suppkey < 60 and s_suppkey % 5 < 2").select(F.concat(F.lit("Place  "), k.cast("string"), F.lit(", Essen")).alias("query"), (k + 100.0).alias("lat"))
    streets = table(spark, d, "customer").where("c_mktsegment < 'C'").select(F.concat("c_mktsegment", F.lit(", Bochum")).alias("query"), F.lit(7.0).alias("lat")).distinct()
    return venues.union(streets).withColumn("lon", F.col("lat"))


LOCATED_SQL = f"""
e AS (
  SELECT c_custkey AS id, c_custkey % 7 = 0 AS park, CASE WHEN c_custkey % 3 > 0 THEN 'Place  ' || (c_custkey % 60)::VARCHAR END AS venue, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS street, CASE WHEN c_custkey % 4 = 0 THEN 'Bochum' ELSE 'Essen' END AS town FROM customer
  WHERE c_custkey % 11 <> 0
), k AS (
  SELECT *, regexp_replace(lower(trim(coalesce(venue, '') || '|' || coalesce(street, '') || '|' || town, '|')), ' +', ' ', 'g') AS key FROM e
), c AS (
  SELECT 'place ' || s_suppkey::VARCHAR || '||essen' AS query, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS lat FROM supplier WHERE s_suppkey < 60 AND (s_suppkey % 3 > 0 OR s_suppkey % 30 < 14)
), geo AS (
  SELECT 'Place  ' || s_suppkey::VARCHAR || ', Essen' AS q, s_suppkey + 100.0::DOUBLE AS lat FROM supplier WHERE s_suppkey < 60 AND s_suppkey % 5 < 2
  UNION ALL SELECT DISTINCT c_mktsegment || ', Bochum', 7.0::DOUBLE FROM customer WHERE c_mktsegment < 'C'
), asked AS (
  SELECT *, row_number() OVER (ORDER BY id) AS nth FROM (SELECT * FROM k WHERE NOT park AND NOT EXISTS (SELECT 1 FROM c WHERE query = key) QUALIFY row_number() OVER (PARTITION BY key ORDER BY id) = 1)
), tries AS (
  SELECT key, id, nth, unnest([{{'at': 1, 'q': venue || ', ' || street}}, {{'at': 2, 'q': venue || ', ' || town}}, {{'at': 3, 'q': street || ', ' || town}}, {{'at': 4, 'q': venue || ', Essen, Germany'}}]) AS t FROM asked
), answers AS (
  SELECT key, any_value(id) AS event_id, any_value(nth) AS nth, arg_min(lat, t.at) AS lat FROM tries LEFT JOIN geo ON q = t.q GROUP BY key
)"""


@query(f"WITH {LOCATED_SQL} SELECT k.id, CASE WHEN park THEN (SELECT lat FROM (SELECT 51.4293::DOUBLE AS lat)) ELSE coalesce(c.lat, answers.lat) END AS lat, 0 AS asked_again FROM k LEFT JOIN c ON c.query = key LEFT JOIN answers USING (key)")
def geocode_write_back(spark, d):
    """Places by the whole ladder, and how many keys a second run has to ask for."""
    from cityfeed.operators.places import locate

    first = locate(_lacking(spark, d), _answered(spark, d), _places(spark, d), NOW, asks=None)
    second = locate(first.events, first.cache, _places(spark, d), NOW, asks=None)
    return second.events.where("archived_at is null").select("id", "lat", F.lit(second.asked.count()).cast("int").alias("asked_again"))


@query(f"WITH {LOCATED_SQL} SELECT key AS query, ((nth - 1) // 20 + 1)::INTEGER AS run, event_id, lat FROM answers WHERE nth <= 60")
def geocode_portions(spark, d):
    """What three runs ask for that may ask for twenty keys each."""
    from cityfeed.operators.places import locate

    events, cache, out = _lacking(spark, d), _answered(spark, d), None
    for run in (1, 2, 3):
        done = locate(events, cache, _places(spark, d), NOW, asks=20)
        asked = done.asked.select("query", F.lit(run).alias("run"), "event_id", "lat")
        events, cache, out = done.events, done.cache, asked if out is None else out.union(asked)
    return out


ANSWERS_SQL = """
WITH RECURSIVE q AS (
  SELECT ['geocode', 'weather', 'robots'][(event_id % 3 + 1)::INTEGER] AS kind, (user_id % 40)::VARCHAR AS key, event_id AS id, ts AS asked_at, value > 250 AS good,
    to_hours(CASE event_id % 3 WHEN 0 THEN CASE WHEN value > 250 THEN 180 * 24 ELSE 14 * 24 END WHEN 1 THEN CASE WHEN value > 250 THEN 24 ELSE 3 END ELSE 1 END) AS holds FROM events
), a AS (
  SELECT kind, key, id, asked_at, holds FROM q QUALIFY row_number() OVER (PARTITION BY kind, key ORDER BY asked_at, id) = 1
  UNION ALL
  SELECT kind, key, id, asked_at, holds FROM (SELECT q.*, row_number() OVER (PARTITION BY a.kind, a.key ORDER BY q.asked_at, q.id) AS rn FROM a JOIN q ON q.kind = a.kind AND q.key = a.key AND q.asked_at >= a.asked_at + a.holds) WHERE rn = 1
)
SELECT q.kind, q.key, q.id, a.id IS NOT NULL AS asked FROM q LEFT JOIN a ON q.kind = a.kind AND q.key = a.key AND q.id = a.id
"""


@query(ANSWERS_SQL)
def answers_again(spark, d):
    """Which questions of a stream have to be asked as the last answer of their key is too old."""
    from cityfeed.streaming.answers import asked_again

    k = F.col("event_id")
    kind = F.element_at(F.array(F.lit("geocode"), F.lit("weather"), F.lit("robots")), (k % 3 + 1).cast("int"))
    rows = table(spark, d, "events").select(kind.alias("kind"), (F.col("user_id") % 40).cast("string").alias("key"), k.alias("id"), F.col("ts").cast("timestamp").alias("at"), (F.col("value") > 250).alias("good"))
    landed = f"{shared_root(spark)}/questions-{uuid.uuid4().hex}"
    rows.write.parquet(landed)
    return asked_again(spark, landed)


@query(
    with_ev(
        GROUPS_SQL + ", pts AS (SELECT id, lat, lon, floor((lon + 180) / 360 * 65536)::BIGINT AS x, floor((0.5 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / (2 * pi())) * 65536)::BIGINT AS y FROM groups WHERE lat IS NOT NULL AND lon IS NOT NULL),"
        " o AS MATERIALIZED (SELECT x, y, min(id) AS p, row_number() OVER (ORDER BY min(id)) AS k FROM pts GROUP BY 1, 2),"
        " r(k, anchors) AS (SELECT 0::BIGINT, []::STRUCT(p BIGINT, x BIGINT, y BIGINT)[] UNION ALL SELECT o.k, CASE WHEN len(list_filter(anchors, lambda a: (a.x - o.x) * (a.x - o.x) + (a.y - o.y) * (a.y - o.y) <= 1600)) > 0 THEN anchors ELSE list_append(anchors, {'p': o.p, 'x': o.x, 'y': o.y}) END FROM r JOIN o ON o.k = r.k + 1),"
        " ended AS (SELECT anchors FROM r ORDER BY k DESC LIMIT 1)"
        " SELECT list_filter(anchors, lambda a: (a.x - pts.x) * (a.x - pts.x) + (a.y - pts.y) * (a.y - pts.y) <= 1600)[1].p AS anchor, count(*) AS n, round(sum(lat) / count(*), 6) AS lat, round(sum(lon) / count(*), 6) AS lon FROM pts, ended GROUP BY 1"
    ).replace("WITH", "WITH RECURSIVE", 1)
)
def map_radius_clusters(spark, d):
    """Clusters of 40 pixels around their first point."""
    return search.radius_clusters(search.feed(ev(spark, d), NOW), 8)


@query(with_ev(GROUPS_SQL + " SELECT canonical_id, (row_number() OVER (ORDER BY canonical_id))::INTEGER AS place, (SELECT count(*) FROM groups) > 25 AS truncated FROM groups ORDER BY canonical_id LIMIT 25"))
def snapshot_capped(spark, d):
    """The first 25 of a snapshot that may hold no more, in the order of its lines."""
    from cityfeed.sources.snapshot import write_snapshot

    path = f"{shared_root(spark)}/snapshot-{uuid.uuid4().hex}"
    counts = write_snapshot(search.feed(ev(spark, d), NOW), NOW, path, "1998-06-01T12:00:00", limit=25)
    lines = spark.read.text(f"{path}/events").select(F.from_json("value", "canonical_id string").alias("e"), F.struct(F.input_file_name(), F.monotonically_increasing_id()).alias("at"))
    kept = lines.agg(F.array_sort(F.collect_list(F.struct("at", "e.canonical_id"))).alias("l"))  # 25 rows
    return kept.select(F.posexplode("l").alias("k", "x")).select("x.canonical_id", (F.col("k") + 1).alias("place"), F.lit(counts["truncated"]).alias("truncated"))


@query(
    "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'shows' END || CASE page_id % 4 WHEN 3 THEN NULL ELSE page_id::VARCHAR END AS bundle FROM pages"
)
def bundle_of_page(spark, d):
    """The script bundle with the shows: named after the section, the same across strings, or the first landed one that holds them."""
    from cityfeed.sources.bundles import show_bundles

    k, key = F.col("page_id"), F.col("page_id").cast("string")
    chunk = lambda name: F.concat(F.lit("/_next/static/chunks/" + name), key, F.lit(".js"))
    scripts = F.concat(F.lit('<script src="'), chunk("first"), F.lit('" async></script><script src="'), chunk("shows"), F.lit('"></script><script src="'), chunk("last"), F.lit('"></script>'))
    by_name = F.concat(F.lit('<script>["EventsSection",0,"'), chunk("a"), F.lit('"]</script>'))
    across = F.concat(F.lit('<script>["EventsSection", "x",\n"y", "'), chunk("b"), F.lit('"]</script>'))
    html = F.when(k % 4 == 0, F.concat(scripts, by_name)).when(k % 4 == 1, F.concat(scripts, across)).otherwise(scripts)
    pages = table(spark, d, "pages").select(k.alias("page_id"), html.alias("payload"))
    text = F.when(k % 4 == 2, 'let c=[{slug:"x"}];"EventsSection"').otherwise("slug:")
    bundles = table(spark, d, "pages").select(F.concat(F.lit("https://artistical.de"), chunk("shows")).alias("url"), text.alias("payload")).union(table(spark, d, "pages").select(F.concat(F.lit("https://artistical.de"), chunk("last")), F.lit('"EventsSection" slug:')).where("page_id % 4 = 2"))
    found = show_bundles(pages, "page_id", bundles)
    return pages.select("page_id").join(found, "page_id", "left").select("page_id", F.regexp_extract("bundle", r"chunks/(.*)\.js$", 1).alias("bundle"))


def _land(spark, d) -> str:
    """Two sources' payloads as files of JSON lines, a folder for each source; some can't be read."""
    k, key = F.col("p_partkey"), F.col("p_partkey").cast("string")
    day = (k % 28 + 1).cast("string")
    block = F.concat(F.lit('<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://g/'), key, F.lit('">'), F.col("p_name"), F.lit('</a></h3><div class="vsel-meta-date">Fr. '), day, F.lit('.6.2026</div><div class="vsel-meta-time">20:00</div></div>'))
    api = F.when(k % 9 == 0, '[{"title": 5}]').otherwise(F.to_json(F.array(F.struct(F.col("p_name").alias("title"), F.concat(F.lit("/e/"), key).alias("url")))))
    part = table(spark, d, "part")
    rows = part.select(F.lit("GREND").alias("source_name"), F.lit("https://g").alias("url"), block.alias("payload")).union(part.select(F.lit("Zollverein"), F.lit("https://z"), api))
    path = f"{shared_root(spark)}/landed-{uuid.uuid4().hex}"
    rows.write.partitionBy("source_name").json(path)
    return path


@query(
    "SELECT 'GREND' AS source_name, p_name AS title, 'https://g/' || p_partkey::VARCHAR AS source_url, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 20, 0, 0) AS start_at, false AS failed FROM part"
    " UNION ALL SELECT 'Zollverein', CASE WHEN p_partkey % 9 > 0 THEN p_name END, CASE WHEN p_partkey % 9 > 0 THEN 'https://www.zollverein.de/e/' || p_partkey::VARCHAR ELSE 'https://z' END, NULL, p_partkey % 9 = 0 FROM part"
)
def landed_source(spark, d):
    """Payloads read by ``spark.read.format("landed")``."""
    from cityfeed.sources.datasource import register

    register(spark)
    out = spark.read.format("landed").option("now", "2026-05-01T12:00:00").load(_land(spark, d))
    return out.select("source_name", "title", "source_url", "start_at", F.col("error").isNotNull().alias("failed"))


@query("SELECT p_partkey, p_name AS title, 'https://g/' || p_partkey::VARCHAR AS source_url, make_timestamp(2026, 6, (p_partkey % 28 + 1)::BIGINT, 20, 0, 0) AS start_at FROM part")
def lateral_events(spark, d):
    """Events of each part's page by a table function in SQL."""
    from cityfeed.sources.lateral import register

    register(spark)
    k = F.col("p_partkey")
    block = F.concat(F.lit('<div class="vsel-content"><h3 class="vsel-meta-title"><a href="https://g/'), k.cast("string"), F.lit('">'), F.col("p_name"), F.lit('</a></h3><div class="vsel-meta-date">Fr. '), (k % 28 + 1).cast("string"), F.lit('.6.2026</div><div class="vsel-meta-time">20:00</div></div>'))
    return spark.sql("SELECT p.p_partkey, e.title, e.source_url, e.start_at FROM {pages} p, LATERAL page_events('GREND', 'https://g', p.payload, '2026-05-01') e WHERE e.error IS NULL", pages=dealt(table(spark, d, "part").select("p_partkey", block.alias("payload"))))
