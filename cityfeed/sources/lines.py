"""Lines of page text as rows, with what stands before and after."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered_lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """``key, pos, line``; a null text has one empty line."""
    return df.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def _by(key: str):
    return Window.partitionBy(key).orderBy("pos")


def carry_forward(lines: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """The last non-null ``value`` up to each line."""
    return lines.withColumn(name, F.last(value, ignorenulls=True).over(_by(key).rowsBetween(Window.unboundedPreceding, 0)))


def look(lines: DataFrame, key: str, value: Column, offset: int, name: str) -> DataFrame:
    """``value`` of the line ``offset`` further on, or back if it is negative."""
    w = _by(key)
    return lines.withColumn(name, F.lead(value, offset).over(w) if offset >= 0 else F.lag(value, -offset).over(w))


def first_acceptable(lines: DataFrame, key: str, value: Column, first: int, last: int, name: str) -> DataFrame:
    """The first non-null ``value`` among the lines from ``first`` to ``last`` relative to each."""
    return lines.withColumn(name, F.first(value, ignorenulls=True).over(_by(key).rowsBetween(first, last)))
