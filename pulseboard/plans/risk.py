"""Risk reports: organisations whose users slip away (R5) and its severity
bands (R17)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.functions.predicates import not_excluded
from pulseboard.functions.text import band
from pulseboard.functions.time import ts_lit
from pulseboard.operators.rollup import rollup_activity, with_user_rule
from pulseboard.params import Bands, Cohort, InternalRule, as_datetime
from pulseboard.sources.bindings import Domain


def slipping_cohort(
    d: Domain,
    as_of,
    group_activities: Iterable[str],
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    cohort: Cohort = Cohort(),
) -> DataFrame:
    """(user_id, organization_id) of non-deleted users with more than
    ``min_events`` group events since ``as_of - lookback`` (strict) and none
    since ``as_of - silent`` (last event strictly before)."""
    as_of = as_datetime(as_of)
    since = as_of - timedelta(days=cohort.lookback_days)
    silent_from = as_of - timedelta(days=cohort.silent_days)
    act = d.counted(since, None, lo_strict=True).filter(
        F.col("activity").isin(list(group_activities)) & not_excluded("organization_id", excluded_orgs)
    )
    per_user = rollup_activity(act, [], [F.max("last_at").alias("last_at"), F.sum("n").alias("n")])
    per_user = per_user.filter(
        (F.col("last_at") < ts_lit(silent_from)) & (F.col("n") > cohort.min_events)
    )
    return with_user_rule(per_user, d.user, internal, user_filter=F.col("is_deleted") == F.lit(False)).select(
        "user_id", "organization_id"
    )


def slipping_away_orgs(
    d: Domain,
    as_of,
    group_activities: Iterable[str],
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    cohort: Cohort = Cohort(),
) -> DataFrame:
    """R5. Per organisation: cohort size ``user_count``, all its users
    ``total_user_count`` (deleted and internal ones too) and
    ``slip_dist = user_count / total_user_count * 100``.

    The two distinct counts are taken separately and joined per organisation
    instead of over the cohort x users product of each organisation.
    Sorted by user_count DESC, slip_dist DESC, org_name ASC.
    """
    members = slipping_cohort(
        d, as_of, group_activities, excluded_orgs, internal=internal, cohort=cohort
    )
    cohort_size = members.groupBy("organization_id").agg(F.count_distinct("user_id").alias("user_count"))
    totals = d.user.groupBy("organization_id").agg(F.count_distinct("user_id").alias("total_user_count"))
    joined = d.org_ext_distinct.join(cohort_size, "organization_id").join(totals, "organization_id")
    out = joined.select(
        F.col("organization_id").alias("org_id"),
        "org_name",
        "user_count",
        "total_user_count",
        (F.col("user_count").cast("double") / F.col("total_user_count") * F.lit(100.0)).alias("slip_dist"),
        "bw_org_id",
        "hs_org_id",
    )
    return out.orderBy(
        F.col("user_count").desc_nulls_first(),
        F.col("slip_dist").desc_nulls_first(),
        F.col("org_name").asc_nulls_last(),
        "org_id",
    )


def slip_severity(slipping: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """R17. ``severity`` high / medium / low of ``slip_dist``."""
    return slipping.withColumn("severity", band("slip_dist", bands.high, bands.medium))
