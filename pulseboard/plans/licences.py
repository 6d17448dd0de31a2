"""Licence reports: concurrent-licence cap exceeded (R3), daily assigned
licences by product family (R6)."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.functions.predicates import matches_family, not_excluded
from pulseboard.functions.time import day_of, within_days
from pulseboard.operators.calendar import Series, attach_daily, day_spine
from pulseboard.operators.counts import weighted_count_where
from pulseboard.operators.rollup import with_user_rule
from pulseboard.params import CAPPED_TYPE_ID, LICENCE_FAMILIES, Family, InternalRule, as_datetime
from pulseboard.sources.bindings import Domain

REPORT_START = ("VR_REPORT_START",)


def concurrent_license_exceeded(
    d: Domain,
    start,
    end,
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    capped_type_id: int = CAPPED_TYPE_ID,
    activities: Iterable[str] = REPORT_START,
) -> DataFrame:
    """R3. Per organisation, cap and day: distinct licensed users of a capped
    subscription who did one of ``activities``, kept when above ``max_users``.

    Licences count only while still assigned (``unassigned_at IS NULL``); the
    user's activity must be in the subscription's organisation. Distinct
    users only, so facts and licences are first reduced to distinct
    (user, organisation, day) and (user, organisation, cap) - no row fan-out.
    """
    start, end = as_datetime(start), as_datetime(end)
    act = d.activity(start, end).filter(
        F.col("activity").isin(list(activities)) & not_excluded("organization_id", excluded_orgs)
    ).select("user_id", "organization_id", day_of("created").alias("created_date"))
    user_days = with_user_rule(act.distinct(), d.user, internal)

    subs = d.org_subscription.filter(F.col("subscription_type_id") == capped_type_id).select(
        "org_subscription_id", "organization_id", "max_users"
    )
    lic = d.user_license.filter(F.col("unassigned_at").isNull()).select("user_id", "org_subscription_id")
    licensed = lic.join(subs, "org_subscription_id").select("user_id", "organization_id", "max_users").distinct()

    # both sides are distinct, so each (day, org, cap, user) occurs once and a
    # plain count is the distinct count (no second aggregation level)
    per_day = (
        user_days.join(licensed, ["user_id", "organization_id"])
        .groupBy("created_date", "organization_id", "max_users")
        .agg(F.count(F.lit(1)).alias("distinct_users"))
        .filter(F.col("distinct_users") > F.col("max_users"))
    )
    out = per_day.join(d.org_ext_distinct, "organization_id").select(
        F.col("organization_id").alias("org_id"),
        "org_name",
        "max_users",
        "distinct_users",
        "created_date",
        "bw_org_id",
        "hs_org_id",
    )
    return out.orderBy(F.col("created_date").desc_nulls_first(), "org_id", "max_users")


def daily_assigned_licenses(
    d: Domain,
    start,
    end,
    *,
    families: Mapping[str, Family] = LICENCE_FAMILIES,
) -> DataFrame:
    """R6. Per calendar day ``start..end`` (whole days, the last one too):
    licences assigned, total ``count_all`` (subscription type named) and per
    family. Days without assignments keep NULL counts.

    Licences are filtered to the calendar's days before aggregating (the
    calendar join alone would aggregate the whole licence history) and
    counted per (day, subscription) before joining subscriptions.
    """
    series = Series.between(as_datetime(start), as_datetime(end))
    lic = d.user_license.filter(within_days("assigned_at", series.first_day, series.last_day))
    per_sub = lic.groupBy(day_of("assigned_at").alias("day"), "org_subscription_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    typed = per_sub.join(
        d.org_subscription.select("org_subscription_id", "subscription_type_id"), "org_subscription_id"
    ).join(d.subscription_type.select("subscription_type_id", "name"), "subscription_type_id")
    named = F.col("name").isNotNull()
    daily = typed.groupBy("day").agg(
        weighted_count_where(named, "n").alias("count_all"),
        *[
            weighted_count_where(named & matches_family("name", fam.prefixes, fam.names), "n").alias(col)
            for col, fam in families.items()
        ],
    )
    spine = day_spine(d.spark, series)
    cols = ["count_all", *families]
    return attach_daily(spine, daily, series).select("day", *cols).orderBy("day")
