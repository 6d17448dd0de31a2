"""Conditional (distinct) counts without Expand or row multiplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_count_by(
    df: DataFrame,
    group_cols: Sequence[str],
    distinct_col: str,
    conditions: Mapping[str, Column | None],
) -> DataFrame:
    """``count(DISTINCT x) [FILTER (WHERE cond)]`` for several conditions.

    Two plain aggregations: first one row per (group, x) holding a flag per
    condition ("any row of x met cond"), then per group a count of non-NULL x
    with the flag set. Both levels aggregate partially before their shuffle,
    so a group holding a third of all rows is combined map-side instead of
    landing on one reducer. ``None`` as condition = unfiltered distinct count.
    """
    flag_names = {name: f"__any_{i}" for i, name in enumerate(conditions)}
    flags = [
        F.max(F.coalesce(cond, F.lit(False))).alias(flag_names[name])
        for name, cond in conditions.items()
        if cond is not None
    ]
    keys = [*group_cols, distinct_col]
    per_value = df.groupBy(*keys).agg(*flags) if flags else df.select(*keys).distinct()
    outs = []
    for name, cond in conditions.items():
        if cond is None:
            outs.append(F.count(distinct_col).alias(name))
        else:
            outs.append(F.count(F.when(F.col(flag_names[name]), F.col(distinct_col))).alias(name))
    return per_value.groupBy(*group_cols).agg(*outs)


def count_where(cond: Column) -> Column:
    """``count(*) FILTER (WHERE cond)`` (NULL condition counts as false)."""
    return F.count(F.when(cond, F.lit(1)))


def weighted_count_where(cond: Column, weight: str | Column) -> Column:
    """``sum(weight)`` over rows meeting ``cond``; 0 when none (never NULL)."""
    w = F.col(weight) if isinstance(weight, str) else weight
    return F.coalesce(F.sum(F.when(cond, w)), F.lit(0)).cast("bigint")
