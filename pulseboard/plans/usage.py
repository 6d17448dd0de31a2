"""Usage reports: daily active organisations (R1), most active touchless
organisations (R4)."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.functions.ids import org_external_ids
from pulseboard.functions.predicates import is_false, is_true, not_excluded
from pulseboard.functions.time import date_lit
from pulseboard.operators.calendar import Series, attach_daily, day_spine
from pulseboard.operators.counts import distinct_count_by, weighted_count_where
from pulseboard.operators.multiplicity import multiplicity
from pulseboard.operators.rollup import rollup_activity, with_user_rule
from pulseboard.params import InternalRule, Targets, as_datetime
from pulseboard.sources.bindings import Domain
from pulseboard.sources.daily import merged_distinct


def daily_active_orgs(
    d: Domain,
    start,
    end,
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    targets: Targets = Targets(),
) -> DataFrame:
    """R1. Per calendar day ``start..end``: distinct organisations with any
    target activity (``total_orga_count``) and per target (``<stem>_orga_count``).

    Events count when ``start <= created <= end`` (a midnight ``end`` admits
    only events at exactly that instant on the last day). Days without
    events keep NULL counts. Sorted by day.
    """
    start, end = as_datetime(start), as_datetime(end)
    codes = targets.codes
    act = d.counted(start, end).filter(
        F.col("activity").isin(list(codes.values())) & not_excluded("organization_id", excluded_orgs)
    )
    flag_cols = {stem: F.max(F.col("activity") == code).alias(f"has_{stem}") for stem, code in codes.items()}
    per_user_day = rollup_activity(act, ["day"], list(flag_cols.values()))
    kept = with_user_rule(per_user_day, d.user, internal)
    conditions = {"total_orga_count": None}
    conditions.update({f"{stem}_orga_count": F.col(f"has_{stem}") for stem in codes})
    daily = distinct_count_by(kept, ["day"], "organization_id", conditions)
    series = Series.between(start, end)
    spine = day_spine(d.spark, series)
    return attach_daily(spine, daily, series).select("day", *conditions).orderBy("day")


def _set_conditions(targets: Targets) -> dict:
    listed = F.col("activity").isin(list(targets.codes.values()))
    counts = {f"{stem}_orga_count": F.col("activity") == code for stem, code in targets.codes.items()}
    return {"total_orga_count": listed, **counts}


def active_orgs_of_days(sets: DataFrame, first_day: date, last_day: date, *, targets: Targets = Targets()) -> DataFrame:
    """R1 over whole days, from the daily bitmaps of organisations
    (:func:`pulseboard.sources.daily.daily_distinct`): the fact is not read.
    Days without events keep NULL counts. Sorted by day."""
    series = Series.days(first_day, last_day)
    conditions = _set_conditions(targets)
    window = sets.filter(F.col("day").between(date_lit(first_day), date_lit(last_day)) & conditions["total_orga_count"])
    daily = merged_distinct(window, ["day"], conditions)
    return attach_daily(day_spine(sets.sparkSession, series), daily, series).select("day", *conditions).orderBy("day")


def active_orgs_of_window(sets: DataFrame, first_day: date, last_day: date, *, targets: Targets = Targets()) -> DataFrame:
    """One row: distinct organisations of the whole window with any target
    activity and with each, from the same bitmaps OR-ed over the days. An
    organisation of several days counts once; without events all are 0."""
    conditions = _set_conditions(targets)
    window = sets.filter(F.col("day").between(date_lit(first_day), date_lit(last_day)) & conditions["total_orga_count"])
    merged = merged_distinct(window, [], conditions)
    return merged.select(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in conditions])


def most_active_touchless_orgs(
    d: Domain,
    start,
    end,
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    targets: Targets = Targets(),
) -> DataFrame:
    """R4. Organisations on a touchless, non-enterprise plan: per target
    activity ``count(*)`` (``<stem>_act``), their sum, distinct users over
    all activities and the last activity time; most active first.

    Counts are multiplied by the number of matching plan-variant rows (and
    profile rows), as the row-level joins would; distinct users and the
    last time are not.
    """
    start, end = as_datetime(start), as_datetime(end)
    codes = targets.codes
    act = d.counted(start, end).filter(not_excluded("organization_id", excluded_orgs))
    plans = multiplicity(
        d.plan_variant.filter(is_true("touchless") & is_false("enterprise")), ["customer_id"], "plan_mult"
    )
    org_plan = d.organization.select("organization_id", "name", "billing_id", "crm_id").join(
        plans, F.col("billing_id") == F.col("customer_id")
    )
    per_user = rollup_activity(
        act,
        [],
        [weighted_count_where(F.col("activity") == code, "n").alias(f"{stem}_act") for stem, code in codes.items()]
        + [F.max("last_at").alias("last_activity")],
    )
    # only organisations on such a plan go on to the user join
    per_user = per_user.join(org_plan.select("organization_id"), "organization_id", "left_semi")
    kept = with_user_rule(per_user, d.user, internal)
    per_org = kept.groupBy("organization_id").agg(
        *[F.sum(f"{stem}_act").alias(f"{stem}_act") for stem in codes],
        F.count_distinct("user_id").alias("overall_uniq_users"),
        F.max("last_activity").alias("last_activity"),
    )
    # one dimension: these organisations with their profiles and the rows behind each
    ext = org_external_ids(org_plan, d.billing_profile, d.crm_profile, keep=["plan_mult"])
    org_dim = ext.groupBy("organization_id", "org_name", "bw_org_id", "hs_org_id").agg(F.sum("plan_mult").alias("mult"))
    joined = per_org.join(org_dim, "organization_id")
    scaled = {stem: (F.col(f"{stem}_act") * F.col("mult")).cast("bigint") for stem in codes}
    out = joined.select(
        F.col("organization_id").alias("org_id"),
        "org_name",
        *[scaled[stem].alias(f"{stem}_act") for stem in codes],
        sum(scaled.values()).cast("bigint").alias("all_activities_count"),
        "overall_uniq_users",
        "last_activity",
        "hs_org_id",
        "bw_org_id",
    )
    return out.orderBy(F.col("all_activities_count").desc_nulls_first(), F.col("org_id"))
