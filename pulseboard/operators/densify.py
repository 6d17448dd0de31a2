"""Densify a (category, day number) series to a full grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def densify_days(rows: DataFrame, key: str, day_col: str, value_col: str, days: int) -> DataFrame:
    """For every category in ``rows``, days ``1..days`` with its value or 0.

    ``rows`` holds at most one row per (category, day) and may carry days
    outside ``1..days``: their category still gets an all-zero series. One
    aggregation per category gathers the in-range values into a map (at most
    ``days`` entries, a bound set by the parameter); the grid is generated
    with ``explode(sequence(1, days))`` - no cross join, no second pass.
    """
    in_range = F.col(day_col).between(1, days)
    per_key = rows.groupBy(key).agg(
        F.map_from_entries(
            F.collect_list(F.when(in_range, F.struct(F.col(day_col).cast("int"), F.col(value_col))))
        ).alias("__by_day")
    )
    grid = per_key.select(key, "__by_day", F.explode(F.sequence(F.lit(1), F.lit(days))).alias(day_col))
    return grid.select(
        F.col(day_col).cast("int").alias(day_col),
        key,
        F.coalesce(F.try_element_at("__by_day", F.col(day_col)), F.lit(0)).cast("bigint").alias(value_col),
    )
