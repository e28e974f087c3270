"""Schemas of the tables that the pipeline keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

EVENTS = (
    "id bigint, canonical_id string, title string, short_description string, start_at timestamp_ntz, end_at timestamp_ntz, is_all_day boolean, is_recurring boolean, is_permanent_offer boolean, category string, source_name string,"
    " source_url string, venue_name string, address_text string, city string, lat double, lon double, distance_km double, travel_time_minutes int, indoor_outdoor string, kids_suitable string, age_note string, price_text string,"
    " weather_note string, image_url string, quality_score double, source_count int, sources_list string, created_at timestamp_ntz, updated_at timestamp_ntz, archived_at timestamp_ntz"
)
CRAWL_RUNS = "id bigint, source_name string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, items_found int, items_created int, items_updated int, items_merged int, error_log string"
GEOCODE_CACHE = "query string, lat double, lon double, fetched_at timestamp_ntz"
WEATHER_CACHE = "target_date date, temp_max double, temp_min double, rain_probability int, weather_code int, hint string, fetched_at timestamp_ntz"

KIDS_SUITABLE = ("yes", "likely", "unknown", "no")
INDOOR_OUTDOOR = ("indoor", "outdoor", "both", "unknown")


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The columns of a schema in its order: missing ones null, others of its type, further ones gone."""
    schema = StructType.fromDDL(ddl)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def in_enum(column: str, values: tuple[str, ...]):
    """The value if it is one of the enumeration, else null."""
    return F.when(F.col(column).isin(*values), F.col(column))
