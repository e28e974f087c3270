"""German dates, local time and date ranges. The current time is always a parameter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ZONE = "Europe/Berlin"

#: German month names and the short forms in use.
MONTHS = {
    "januar": 1, "jan": 1, "februar": 2, "feb": 2, "märz": 3, "mär": 3, "maerz": 3, "mrz": 3, "april": 4, "apr": 4, "mai": 5, "juni": 6, "jun": 6,
    "juli": 7, "jul": 7, "august": 8, "aug": 8, "september": 9, "sep": 9, "sept": 9, "oktober": 10, "okt": 10, "november": 11, "nov": 11, "dezember": 12, "dez": 12,
}

#: Formats of dates with four-digit years, tried in turn.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "dd.MM.yyyy HH:mm", "dd.MM.yyyy"]


def month_number(name: Column) -> Column:
    """Number of a German month name, a final dot aside; null if unknown."""
    key = F.rtrim(F.lower(F.trim(name)), F.lit("."))
    table = F.create_map(*[F.lit(x) for item in MONTHS.items() for x in item])
    return F.try_element_at(table, key)


def now_berlin() -> Column:
    """Wall-clock time in Berlin, for callers that hand it on as their ``now``."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()).cast("timestamp_ntz"))


def make_timestamp(year: Column, month: Column, day: Column, hour=0, minute=0) -> Column:
    """Local time of the parts; null for a day or time that doesn't exist."""
    lit = lambda c: c if isinstance(c, Column) else F.lit(c)
    return F.try_make_timestamp_ntz(year, month, day, lit(hour), lit(minute), F.lit(0))


def berlin_from_utc(c: Column) -> Column:
    """Wall-clock time in Berlin of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), c.cast("timestamp_ntz"))


def berlin_from_iso(c: Column) -> Column:
    """Wall-clock time in Berlin of an ISO string; one without offset is taken as it is."""
    zoned = c.rlike(r"(Z|[+-][0-9]{2}:?[0-9]{2})$")
    return F.when(zoned, F.convert_timezone(F.lit("UTC"), F.lit(ZONE), F.to_utc_timestamp(F.try_to_timestamp(c), F.current_timezone()).cast("timestamp_ntz"))).otherwise(parse_plain(c))


def parse_plain(c: Column) -> Column:
    """The first of the plain formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(c), F.lit(f)).cast("timestamp_ntz") for f in FORMATS])


def _int(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return F.when(found != "", found).cast("int")


def time_of(text: Column) -> tuple[Column, Column]:
    """Hour and minute of the first ``HH:MM`` or ``HH.MM Uhr`` or ``HH Uhr``, null without one."""
    clock = r"(?<![0-9.])([0-9]{1,2})[:.]([0-9]{2})(?![0-9.])"
    full = r"(?<![0-9.])([0-9]{1,2})\s*Uhr"
    return F.coalesce(_int(text, clock, 1), _int(text, full, 1)), F.coalesce(_int(text, clock, 2), F.when(_int(text, full, 1).isNotNull(), 0))


def parse_german(text: Column, default_year: Column, default_hour: int = 0) -> Column:
    """``7. Juli 2026, 18:30``, ``12. Mai`` or ``3.6.2026 20 Uhr``; null if there is no date or it doesn't exist."""
    named = r"(?U)([0-9]{1,2})\.\s*(\p{L}+)\.?\s*([0-9]{4})?"
    digits = r"([0-9]{1,2})\.([0-9]{1,2})\.([0-9]{4}|[0-9]{2})?"
    month_name = F.when(F.regexp_extract(text, named, 2) != "", F.regexp_extract(text, named, 2))
    by_name = month_number(month_name)
    short_year = _int(text, digits, 3)
    year = F.when(by_name.isNotNull(), F.coalesce(_int(text, named, 3), default_year)).otherwise(F.coalesce(F.when(short_year < 100, short_year + 2000).otherwise(short_year), default_year))
    day = F.when(by_name.isNotNull(), _int(text, named, 1)).otherwise(_int(text, digits, 1))
    month = F.coalesce(by_name, _int(text, digits, 2))
    rest = F.regexp_replace(F.regexp_replace(text, digits, " "), named, " ")
    hour, minute = time_of(rest)
    return make_timestamp(year, month, day, F.coalesce(hour, F.lit(default_hour)), F.coalesce(minute, F.lit(0)))


def start_of_day(c: Column) -> Column:
    return F.date_trunc("day", c).cast("timestamp_ntz")


def time_of_day(c: Column) -> Column:
    """morning before 12, afternoon before 18, evening."""
    hour = F.hour(c)
    return F.when(hour < 12, "morning").when(hour < 18, "afternoon").when(hour.isNotNull(), "evening")


def range_bounds(name: str, now: Column) -> tuple[Column, Column]:
    """First and last day of today, tomorrow or the weekend; on a Sunday the weekend began the day before."""
    today = F.to_date(now)
    weekday = F.dayofweek(today)  # Sunday is 1
    saturday = F.when(weekday == 1, F.date_sub(today, 1)).otherwise(F.date_add(today, F.lit(7) - weekday))
    return {"today": (today, today), "tomorrow": (F.date_add(today, 1), F.date_add(today, 1)), "weekend": (saturday, F.date_add(saturday, 1))}[name]


def day_label(c: Column, now: Column) -> Column:
    """Heute, Morgen, Wochenende within six days, else null."""
    ahead = F.datediff(c, now)
    return F.when(ahead == 0, "Heute").when(ahead == 1, "Morgen").when(ahead.between(2, 6) & F.dayofweek(c).isin(1, 7), "Wochenende")


def first_of(columns: list[Column]) -> Column:
    return reduce(lambda a, b: F.coalesce(a, b), columns)
