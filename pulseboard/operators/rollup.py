"""Aggregate the activity fact before joining it.

Every report filters the activity fact, joins users (for the internal-account
rule), then aggregates. Spark does not push an aggregation below a join, so
the fact would be shuffled row by row into the user join. Rolling it up first
to one row per (user, organisation, keys) aggregates map-side and shuffles a
fraction of the rows; the rule only needs (organisation, username), which the
rolled-up row still has, so the result is the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from pulseboard.functions.predicates import keep_external
from pulseboard.params import InternalRule


def rollup_activity(
    activity: DataFrame, keys: Sequence[str | Column], aggs: Sequence[Column]
) -> DataFrame:
    """``groupBy(user_id, organization_id, *keys).agg(*aggs)``."""
    return activity.groupBy("user_id", "organization_id", *keys).agg(*aggs)


def with_user_rule(
    rows: DataFrame,
    users: DataFrame,
    rule: InternalRule | None,
    how: str = "inner",
    user_filter: Column | None = None,
    keep_username: bool = False,
) -> DataFrame:
    """Join users on ``user_id`` and keep rows that pass the internal rule.

    ``how='left'`` keeps rows without a user (they pass only in the exempt
    organisation, as in SQL). ``user_filter`` restricts the users first.
    """
    u = users.select("user_id", "username", *(["is_deleted"] if user_filter is not None else []))
    if user_filter is not None:
        u = u.filter(user_filter).drop("is_deleted")
    joined = rows.join(u, "user_id", how)
    if rule is not None:
        joined = joined.filter(keep_external("organization_id", "username", rule))
    return joined if keep_username else joined.drop("username")
