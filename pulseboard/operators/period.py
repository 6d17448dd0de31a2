"""Period-over-period pairing of a per-day series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseboard.functions.time import date_lit
from pulseboard.params import PeriodPair


def pair_by_position(daily: DataFrame, previous: Column, partner: Column, value_cols: Sequence[str]) -> DataFrame:
    """Rows ``day, *values, prev_day, *prev_values`` for the days that are not ``previous``.

    ``daily`` holds one row per day. Days meet by position: a previous day
    stands at the position of the day that ``partner`` names. One grouping
    with a conditional maximum per side pairs them, so the series (and the
    fact below it) is computed once; a day without a partner keeps NULLs.
    """
    position = F.when(previous, partner).otherwise(F.col("day"))
    sided = daily.select(position.alias("position"), previous.alias("previous"), "day", *value_cols)
    now, before = ~F.col("previous"), F.col("previous")
    paired = sided.groupBy("position").agg(
        *[F.max(F.when(now, F.col(c))).alias(c) for c in ("day", *value_cols)],
        *[F.max(F.when(before, F.col(c))).alias(f"prev_{c}") for c in ("day", *value_cols)],
    )
    return paired.filter(F.col("day").isNotNull()).drop("position")


def pair_with_previous(daily: DataFrame, pair: PeriodPair, value_cols: Sequence[str]) -> DataFrame:
    """:func:`pair_by_position` of the current days ``start+1 .. end`` with the days ``n_days`` earlier.

    ``daily`` holds one (zero-filled) row per day of the combined series
    (``2 * n_days`` rows).
    """
    day = F.col("day")
    previous = day < date_lit(pair.first_current_day)
    return pair_by_position(daily.filter(day <= date_lit(pair.last_day)), previous, F.date_add(day, pair.n_days), value_cols)
