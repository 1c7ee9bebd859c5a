"""Calendar helpers. All work on dates, so no result depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truncate_to(ts: Column | str, unit: str) -> Column:
    """Start of the day, week (Monday), month, quarter or year, as ``timestamp_ntz``."""
    day = _col(ts).cast("date")
    return (day if unit == "day" else F.trunc(day, unit)).cast("timestamp_ntz")


def days_between(start: Column | str, end: Column | str) -> Column:
    return F.datediff(_col(end).cast("date"), _col(start).cast("date")).cast("bigint")


def months_between_boundaries(start: Column | str, end: Column | str) -> Column:
    """Number of month boundaries crossed: 31 January to 1 February counts 1."""
    a, b = _col(start), _col(end)
    return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")


def month_key(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM")


def month_label(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "MMM yyyy")


def day_name(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "EEEE")


def weekday_number(ts: Column | str) -> Column:
    """0 for Sunday to 6 for Saturday."""
    return (F.dayofweek(_col(ts)) - 1).cast("bigint")
