"""An event table derived from the order tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cityfeed.functions.geo import distance_km, quality_score, travel_minutes
from cityfeed.sources.tables import table

NOW = datetime(1998, 6, 1, 12)


def ev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event per order that has a first line."""
    line = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_partkey").alias("p_partkey"), F.min("l_discount").alias("discount"))
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey").withColumnRenamed("o_custkey", "c_custkey")
    rows = line.join(orders, "l_orderkey").join(table(spark, sf_dir, "part"), "p_partkey").join(table(spark, sf_dir, "customer"), "c_custkey")
    k = F.col("l_orderkey")
    placed = F.col("c_nationkey") % 7 != 0
    out = rows.select(
        k.alias("id"),
        F.substring(F.md5(F.concat(F.lit("ev_"), k.cast("string"))), 1, 16).alias("canonical_id"),
        F.col("p_name").alias("title"),
        F.concat("p_type", F.lit(" with "), "p_name").alias("short_description"),
        F.when(k % 11 != 0, F.timestamp_add("HOUR", (k % 24).cast("int"), F.col("o_orderdate"))).alias("start_at"),
        (k % 17 == 0).alias("is_permanent_offer"),
        F.expr("nullif(o_orderpriority, '4-NOT SPECIFIED')").alias("category"),
        F.col("c_mktsegment").alias("source_name"),
        F.concat(F.lit("https://example.org/e/"), k.cast("string")).alias("source_url"),
        F.col("c_name").alias("venue_name"),
        F.lit(None).cast("string").alias("address_text"),
        F.when(placed, F.lit(51.0) + F.col("c_nationkey") * F.lit(0.05)).alias("lat"),
        F.when(placed, F.lit(6.5) + (F.col("c_custkey") % 20) * F.lit(0.06)).alias("lon"),
        F.element_at(F.array(*[F.lit(x) for x in ("yes", "likely", "unknown", "no")]), (k % 4 + 1).cast("int")).alias("kids_suitable"),
        F.element_at(F.array(*[F.lit(x) for x in ("indoor", "outdoor", "both", "unknown")]), (F.floor(k / 4) % 4 + 1).cast("int")).alias("indoor_outdoor"),
        F.when(F.col("discount") > 0.05, F.concat(F.lit("EUR "), (k % 50).cast("string"))).alias("price_text"),
        (1 + (k % 3) % 2).cast("int").alias("source_count"),
        F.col("c_mktsegment").alias("sources_list"),
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("archived_at"),
    )
    km = distance_km(F.col("lat"), F.col("lon"))
    return out.withColumn("quality_score", quality_score()).withColumn("distance_km", km).withColumn("travel_time_minutes", travel_minutes(km))


EV_SQL = """
first_line AS (
  SELECT l_orderkey, min(l_partkey) AS p_partkey, min(l_discount) AS discount FROM lineitem WHERE l_linenumber = 1 GROUP BY 1
), ev0 AS (
  SELECT o_orderkey AS id, substr(md5('ev_' || o_orderkey::VARCHAR), 1, 16) AS canonical_id, p_name AS title, p_type || ' with ' || p_name AS short_description,
    CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate + to_hours((o_orderkey % 24)::INTEGER) END AS start_at, o_orderkey % 17 = 0 AS is_permanent_offer,
    nullif(o_orderpriority, '4-NOT SPECIFIED') AS category, c_mktsegment AS source_name, 'https://example.org/e/' || o_orderkey::VARCHAR AS source_url, c_name AS venue_name,
    NULL::VARCHAR AS address_text, CASE WHEN c_nationkey % 7 <> 0 THEN 51.0::DOUBLE + c_nationkey * 0.05::DOUBLE END AS lat,
    CASE WHEN c_nationkey % 7 <> 0 THEN 6.5::DOUBLE + (c_custkey % 20) * 0.06::DOUBLE END AS lon,
    ['yes', 'likely', 'unknown', 'no'][(o_orderkey % 4 + 1)::INTEGER] AS kids_suitable, ['indoor', 'outdoor', 'both', 'unknown'][((o_orderkey // 4) % 4 + 1)::INTEGER] AS indoor_outdoor,
    CASE WHEN discount > 0.05 THEN 'EUR ' || (o_orderkey % 50)::VARCHAR END AS price_text, (1 + (o_orderkey % 3) % 2)::INTEGER AS source_count, c_mktsegment AS sources_list,
    CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS archived_at
  FROM first_line JOIN orders ON l_orderkey = o_orderkey JOIN part USING (p_partkey) JOIN customer ON o_custkey = c_custkey
), ev1 AS (
  SELECT *, round(least(1.0::DOUBLE, (CASE WHEN start_at IS NOT NULL OR is_permanent_offer THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN venue_name <> '' THEN 0.15 ELSE 0 END)::DOUBLE
    + (CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN length(short_description) >= 30 THEN 0.1 ELSE 0 END)::DOUBLE
    + (CASE WHEN category <> '' THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN price_text <> '' THEN 0.05 ELSE 0 END)::DOUBLE + (CASE WHEN source_count > 1 THEN 0.2 ELSE 0 END)::DOUBLE), 3) AS quality_score,
    round(2 * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians(lat) - radians(51.3833::DOUBLE)) / 2), 2) + cos(radians(51.3833::DOUBLE)) * cos(radians(lat)) * pow(sin((radians(lon) - radians(7.0333::DOUBLE)) / 2), 2))), 1) AS distance_km
  FROM ev0
), ev AS (
  SELECT *, CASE WHEN distance_km <= 0 THEN 0 ELSE round_even(5 + distance_km / 30.0::DOUBLE * 60, 0)::INTEGER END AS travel_time_minutes,
    array_to_string(list_filter(string_split(regexp_replace(lower(title), '[^\\p{L}\\p{N}_ ]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (@GROUP_STOP@)), ' ') AS title_key,
    list_distinct(list_filter(string_split(regexp_replace(lower(title), '[^\\p{L}\\p{N}_ ]+', ' ', 'g'), ' '), lambda w: w <> '' AND w NOT IN (@DEDUP_STOP@))) AS words
  FROM ev1
)"""


def _quoted(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _ev_sql() -> str:
    from cityfeed.functions.text import DEDUP_STOPWORDS, GROUP_STOPWORDS

    return EV_SQL.replace("@GROUP_STOP@", _quoted(GROUP_STOPWORDS)).replace("@DEDUP_STOP@", _quoted(DEDUP_STOPWORDS))


EV_SQL = _ev_sql()
NOW_SQL = "TIMESTAMP '1998-06-01 12:00:00'"
VISIBLE_SQL = f"archived_at IS NULL AND (start_at IS NULL OR start_at >= {NOW_SQL} OR is_permanent_offer)"


def with_ev(body: str) -> str:
    return f"WITH {EV_SQL}\n{body}"


def grouped_sql(source: str) -> str:
    """CTEs ``m, rep, occ, groups`` over the rows of ``source``, a FROM clause with filters."""
    return f"""m AS (
  SELECT *, CASE WHEN title_key = '' THEN '__unique_' || id::VARCHAR ELSE title_key END AS group_title, lower(coalesce(source_name, '')) AS group_source FROM {source}
), rep AS (
  SELECT *, row_number() OVER (PARTITION BY group_title, group_source ORDER BY CASE WHEN start_at >= {NOW_SQL} THEN 0 ELSE 1 END,
    CASE WHEN start_at >= {NOW_SQL} THEN start_at END NULLS LAST, CASE WHEN start_at >= {NOW_SQL} THEN NULL ELSE -coalesce(quality_score, 0) END NULLS LAST, id) AS rn FROM m
), occ AS (
  SELECT group_title, group_source, count(*) AS n_occurrences, coalesce(min(start_at) FILTER (start_at >= {NOW_SQL}), min(start_at)) AS headline_at,
    string_agg(id::VARCHAR, ',' ORDER BY start_at NULLS LAST, id) AS occurrence_ids,
    list({{'id': id, 'start_at': start_at}} ORDER BY start_at NULLS LAST, id) AS occurrences FROM m GROUP BY 1, 2
), groups AS (
  SELECT * FROM (SELECT * EXCLUDE (rn) FROM rep WHERE rn = 1) JOIN occ USING (group_title, group_source)
)"""
