"""Calendar spine: one row per day, and ways to hang data on it."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseboard.functions.time import date_lit
from pulseboard.operators.broadcast import bounded_broadcast
from pulseboard.params import as_datetime, is_midnight


@dataclass(frozen=True)
class Series:
    """Points ``start, start + 1 day, ...`` up to ``end`` (both inclusive).

    ``aligned`` is False when ``start`` is not a midnight: its points then
    never equal a day bucket, so nothing attaches to them.
    """

    first_day: date
    n_points: int
    aligned: bool

    @property
    def last_day(self) -> date:
        return self.first_day + timedelta(days=max(self.n_points - 1, 0))

    @classmethod
    def between(cls, start, end) -> "Series":
        s, e = as_datetime(start), as_datetime(end)
        if e < s:
            return cls(s.date(), 0, is_midnight(s))
        n = int((e - s) // timedelta(days=1)) + 1
        return cls(s.date(), n, is_midnight(s))

    @classmethod
    def days(cls, first_day: date, last_day: date) -> "Series":
        return cls(first_day, max((last_day - first_day).days + 1, 0), True)


def day_spine(spark: SparkSession, series: Series, name: str = "day") -> DataFrame:
    """``day`` DATE column with ``series.n_points`` rows (empty, typed, when 0).

    Built from ``spark.range`` so no rows travel from the driver; the guard on
    an empty series replaces ``sequence()``'s error for start > end.
    """
    n = max(series.n_points, 0)
    return spark.range(0, n, 1, 1).select(
        F.date_add(date_lit(series.first_day), F.col("id").cast("int")).alias(name)
    )


def attach_daily(spine: DataFrame, daily: DataFrame, series: Series, on: str = "day") -> DataFrame:
    """Spine LEFT JOIN a per-day aggregate; days without data keep NULLs.

    ``daily`` must already be restricted to the series' days, so it has at
    most ``n_points`` rows - a proven bound, hence broadcast.
    """
    if not series.aligned:
        daily = daily.filter(F.lit(False))
    return spine.join(bounded_broadcast(daily), on, "left")


def attach_detail(
    spine: DataFrame,
    detail: DataFrame,
    series: Series,
    on: str = "day",
    present: DataFrame | None = None,
) -> DataFrame:
    """Every detail row plus one blank row per spine day that has none.

    Equal to ``spine LEFT JOIN detail ON day`` when every detail day lies on the
    spine (the caller's range filter guarantees it), but the detail side is
    never shuffled by day: a calendar join would send each day's rows to one
    task, so a hot day would sit on a single core. Blank days come from an
    anti join against the days present (at most ``n_points`` rows); callers
    can pass ``present`` computed more cheaply than from the detail rows.
    """
    if not series.aligned:
        blank = spine
        detail = detail.filter(F.lit(False))
    else:
        days = (present if present is not None else detail).select(on).distinct()
        blank = spine.join(bounded_broadcast(days), on, "left_anti")
    return detail.unionByName(blank, allowMissingColumns=True)
