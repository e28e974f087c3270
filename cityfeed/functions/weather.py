"""Weather hints and how long cached answers hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days ahead for which a forecast is looked up.
FORECAST_DAYS = 7


def hint(rain: Column, code: Column, warmest: Column) -> Column:
    """Advice from chance of rain, weather code and highest temperature."""
    degrees = F.regexp_replace(F.format_number(warmest, 0), ",", "")
    return (
        F.when(code >= 95, "Gewitter erwartet - Indoor sinnvoll")
        .when((code >= 61) | (rain >= 70), "Regen wahrscheinlich - Indoor sinnvoll")
        .when((code >= 51) | (rain >= 40), "Wetterabhängig - Regenschirm mitnehmen")
        .when(warmest >= 28, F.concat(F.lit("Warm ("), degrees, F.lit("°C) - Sonnenschutz empfohlen")))
        .when(warmest <= 2, F.concat(F.lit("Kalt ("), degrees, F.lit("°C) - Warm anziehen")))
        .when(code <= 1, F.concat(F.lit("Schönes Wetter ("), degrees, F.lit("°C) - Gut für Outdoor")))
        .otherwise(F.concat(degrees, F.lit("°C - Gut bei jedem Wetter")))
    )


def icon(code: Column) -> Column:
    """Name of the picture for a weather code."""
    steps = [(95, "thunder"), (71, "snow"), (61, "rain"), (51, "drizzle")]
    out = F.when(code.isNull(), "cloud")
    for least, name in steps:
        out = out.when(code >= least, name)
    return out.when(code <= 1, "sun").otherwise("cloud")


def within_forecast(start: Column, today: Column) -> Column:
    return F.datediff(start, today).between(0, FORECAST_DAYS)


def with_weather(events: DataFrame, weather: DataFrame, today) -> DataFrame:
    """``weather_note`` of events in the forecast days from ``weather(target_date, hint)``; other notes stay."""
    days = weather.where("hint is not null and hint <> ''").select(F.col("target_date").alias("_day"), F.col("hint").alias("_hint"))
    out = events.join(days, F.to_date("start_at") == F.col("_day"), "left")
    note = F.when(within_forecast(F.col("start_at"), F.lit(today)) & F.col("_hint").isNotNull(), F.col("_hint")).otherwise(F.col("weather_note"))
    return out.withColumn("weather_note", note).drop("_day", "_hint")


def weather_fresh(fetched: Column, target: Column, now: Column) -> Column:
    """3 hours for today's forecast, 24 for others."""
    return now - fetched < F.when(target == F.to_date(now), F.expr("INTERVAL 3 HOURS")).otherwise(F.expr("INTERVAL 24 HOURS"))


def geocode_fresh(fetched: Column, lat: Column, now: Column) -> Column:
    """180 days for a place, 14 for a miss."""
    return now - fetched < F.when(lat.isNotNull(), F.expr("INTERVAL '180' DAY")).otherwise(F.expr("INTERVAL '14' DAY"))


DAILY = "daily struct<time:array<string>,temperature_2m_max:array<double>,temperature_2m_min:array<double>,precipitation_probability_max:array<int>,weathercode:array<int>>"


def forecast_rows(answers: DataFrame) -> DataFrame:
    """Rows of the weather table from ``(target_date, payload, fetched_at)`` answers of the forecast service; an answer without a day gives none."""
    day = F.from_json("payload", DAILY)["daily"]
    first = lambda name: F.get(day[name], F.lit(0))
    rows = answers.where(F.size(F.coalesce(day["time"], F.array().cast("array<string>"))) > 0).select(
        F.col("target_date").cast("date").alias("target_date"),
        first("temperature_2m_max").alias("temp_max"),
        first("temperature_2m_min").alias("temp_min"),
        first("precipitation_probability_max").alias("rain_probability"),
        first("weathercode").alias("weather_code"),
        "fetched_at",
    )
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.withColumn("hint", hint(zero("rain_probability"), zero("weather_code"), zero("temp_max")))


def put_forecasts(cache: DataFrame, rows: DataFrame) -> DataFrame:
    """The weather table with the newest row of each day."""
    both = cache.select(rows.columns).unionByName(rows)
    rest = [c for c in rows.columns if c not in ("target_date", "fetched_at")]
    newest = both.groupBy("target_date").agg(F.max(F.struct("fetched_at", *rest)).alias("m"))
    return newest.select("target_date", *[f"m.{c}" for c in rest], "m.fetched_at")


def banner(weather: DataFrame, today) -> DataFrame:
    """The row shown above the list: today's, and only today's."""
    shown = weather.where(F.col("target_date") == F.lit(today))
    degrees = F.when(F.col("temp_max").isNull(), "–").otherwise(F.concat(F.floor(F.col("temp_max") + 0.5).cast("string"), F.lit("°C")))
    rain = F.when(F.col("rain_probability").isNotNull(), F.concat(F.col("rain_probability").cast("string"), F.lit("% Regen")))
    return shown.select("target_date", degrees.alias("temperature"), rain.alias("rain"), icon(F.col("weather_code")).alias("icon"), "hint")
