"""Time literals and day bucketing.

Literals are built from ISO strings and cast to TIMESTAMP_NTZ / DATE on the
JVM side, so a naive Python datetime is never reinterpreted in the driver's
local zone and Catalyst folds them into constants (pushed to Parquet).
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulseboard.params import as_datetime


def ts_lit(value: date | datetime | str) -> Column:
    """A TIMESTAMP_NTZ literal for a report bound."""
    return F.lit(as_datetime(value).isoformat(sep=" ")).cast("timestamp_ntz")


def date_lit(value: date | datetime | str) -> Column:
    """A DATE literal."""
    if isinstance(value, datetime):
        value = value.date()
    elif isinstance(value, str):
        value = as_datetime(value).date()
    return F.lit(value.isoformat()).cast("date")


def day_of(col: str | Column) -> Column:
    """Calendar day of a timestamp (``date_trunc('day', ts)`` as a DATE)."""
    return F.to_date(F.col(col) if isinstance(col, str) else col)


def within_days(col: str | Column, first_day: date, last_day: date) -> Column:
    """Whole days ``first_day 00:00 <= col < last_day + 1 day``."""
    c = F.col(col) if isinstance(col, str) else col
    return (c >= ts_lit(first_day)) & (c < F.date_add(date_lit(last_day), 1).cast("timestamp_ntz"))


def format_utc(col: str | Column) -> Column:
    """``2024-01-05, 13:04:05 UTC`` rendering of a timestamp."""
    c = F.col(col) if isinstance(col, str) else col
    return F.date_format(c, "yyyy-MM-dd, HH:mm:ss 'UTC'")
