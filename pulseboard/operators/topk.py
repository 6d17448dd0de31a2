"""Top-1 row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top1_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``row_number() OVER (PARTITION BY group ORDER BY order) = 1``.

    Catalyst turns the rank filter into a ``WindowGroupLimit`` that keeps one
    row per group in each map task before the shuffle, so a group with many
    rows ships only its local winners. ``order`` should be a total order
    (add tie-breaks) to make the pick deterministic.
    """
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") == 1).drop("__rank")
