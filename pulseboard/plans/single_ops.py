"""Single operators of SURVEY section 2.3-2.10, each run on its own over the
whole test tables (no date window unless the operator is about one).

Each entry takes ``(spark, sf_dir)``; ``duck_oracle.single_ops`` holds the
DuckDB twin. Names follow the operator, not a report.
"""

from __future__ import annotations

import os
import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseboard.functions.ids import org_external_ids
from pulseboard.functions.predicates import (
    is_false,
    is_true,
    matches_family,
    not_excluded,
    not_in_list_keep_null,
)
from pulseboard.functions.text import band, fold_other, product_of
from pulseboard.functions.time import day_of, within_days
from pulseboard.operators.calendar import Series, attach_daily, day_spine
from pulseboard.operators.counts import count_where, distinct_count_by
from pulseboard.operators.period import pair_with_previous
from pulseboard.operators.rollup import rollup_activity
from pulseboard.operators.topk import top1_per_group
from pulseboard.params import PeriodPair
from pulseboard.plans.catalog import EVENT_TYPES, P, _domain

# Fixed parameters of the single-operator runs.
SPINE_DAYS = (date(2023, 12, 28), date(2024, 2, 3))
EXCLUDED_ORGS = (1, 2, 3)
HEAVY_MIN_EVENTS = 8
PAIR_PERIOD = (date(2024, 1, 15), date(2024, 1, 30))
SHARE_BANDS = (21.0, 19.0)


def calendar_spine_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day of a calendar wider than the data, events per day
    (NULL where none)."""
    d = _domain(spark, sf_dir)
    series = Series.days(*SPINE_DAYS)
    daily = (
        d.user_activity.filter(within_days("created", *SPINE_DAYS))
        .groupBy(day_of("created").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    return attach_daily(day_spine(spark, series), daily, series).orderBy("day")


def _events_per_org(df: DataFrame) -> DataFrame:
    return df.groupBy("organization_id").agg(F.count(F.lit(1)).alias("n_events"))


def exclusion_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 with a list: ``organization_id <> ALL(list)`` (NULL dropped)."""
    d = _domain(spark, sf_dir)
    return _events_per_org(d.user_activity.filter(not_excluded("organization_id", EXCLUDED_ORGS)))


def exclusion_empty_list_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 with an empty list: every row kept, NULL organisations too."""
    d = _domain(spark, sf_dir)
    return _events_per_org(d.user_activity.filter(not_excluded("organization_id", [])))


def not_exists_activity_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``NOT EXISTS (unnest(list))``; NULL activities are kept."""
    d = _domain(spark, sf_dir)
    kept = d.user_activity.filter(not_in_list_keep_null("activity", P.excluded_activities))
    return kept.groupBy("activity").agg(F.count(F.lit(1)).alias("n_events"))


def json_text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """X11: ``payload ->> 'k'`` as text, events per value."""
    d = _domain(spark, sf_dir)
    return d.user_activity.groupBy(F.get_json_object("payload", "$.k").alias("meta")).agg(
        F.count(F.lit(1)).alias("n_events")
    )


def external_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Billing and CRM id of every organisation."""
    d = _domain(spark, sf_dir)
    return org_external_ids(d.organization, d.billing_profile, d.crm_profile)


def heavy_users_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user, organisation) groups with ``count(*) > 8`` (HAVING),
    with their last event."""
    d = _domain(spark, sf_dir)
    per_user = rollup_activity(
        d.user_activity, [], [F.count(F.lit(1)).alias("n_events"), F.max("created").alias("last_at")]
    )
    return per_user.filter(F.col("n_events") > HEAVY_MIN_EVENTS)


def daily_conditional_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3/A4: per day distinct organisations, overall and with a filter."""
    d = _domain(spark, sf_dir)
    act = d.user_activity.select("organization_id", "activity", day_of("created").alias("day"))
    return distinct_count_by(
        act,
        ["day"],
        "organization_id",
        {
            "orgs": None,
            "orgs_error": F.col("activity").endswith("_ERROR"),
            "orgs_purchase": F.col("activity").endswith("_PURCHASE"),
        },
    )


def org_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``count(*) FILTER (WHERE ...)`` per event type and their sum."""
    d = _domain(spark, sf_dir)
    typed = {t.lower(): F.col("activity").endswith(f"_{t}") for t in EVENT_TYPES}
    out = d.user_activity.groupBy("organization_id").agg(
        *[count_where(c).alias(f"n_{k}") for k, c in typed.items()]
    )
    return out.withColumn("n_typed", sum(F.col(f"n_{k}") for k in typed).cast("bigint"))


def top_org_per_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per activity the organisation with most events (ties: smaller
    id), from an aggregate."""
    d = _domain(spark, sf_dir)
    counts = d.user_activity.groupBy("activity", "organization_id").agg(F.count(F.lit(1)).alias("n_events"))
    return top1_per_group(counts, ["activity"], [F.col("n_events").desc(), F.col("organization_id").asc()])


def daily_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per day of a period, zero-filled, paired with the day
    ``n_days`` earlier."""
    d = _domain(spark, sf_dir)
    pair = PeriodPair.of(*PAIR_PERIOD)
    series = Series.days(pair.series_start, pair.last_day)
    per_day = (
        d.user_activity.filter(within_days("created", pair.series_start, pair.last_day))
        .groupBy(day_of("created").alias("day"))
        .agg(F.count(F.lit(1)).alias("n_events"))
    )
    daily = attach_daily(day_spine(spark, series), per_day, series).select(
        "day", F.coalesce("n_events", F.lit(0)).cast("bigint").alias("n_events")
    )
    return pair_with_previous(daily, pair, ["n_events"])


def product_fold_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by product prefix, unlisted prefixes as OTHER."""
    d = _domain(spark, sf_dir)
    prods = P.products
    per = d.user_activity.groupBy(fold_other(product_of("activity"), prods.products, prods.other).alias("product"))
    return per.agg(F.count(F.lit(1)).alias("n_events"))


def org_error_share_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of error events per organisation (x100, double) and
    its band."""
    d = _domain(spark, sf_dir)
    per = d.user_activity.groupBy("organization_id").agg(
        count_where(F.col("activity").endswith("_ERROR")).alias("n_error"),
        F.count(F.lit(1)).alias("n_events"),
    )
    share = (F.col("n_error").cast("double") / F.col("n_events") * F.lit(100.0)).alias("error_share")
    high, medium = SHARE_BANDS
    return per.select("organization_id", share).withColumn("severity", band("error_share", high, medium))


def days_since_first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by whole days since the user's first event. The first day
    is an aggregate per user joined back (no window over a possibly huge
    user partition)."""
    d = _domain(spark, sf_dir)
    per_day = d.user_activity.groupBy("user_id", day_of("created").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )
    first = per_day.groupBy("user_id").agg(F.min("day").alias("first_day"))
    joined = per_day.join(first, "user_id")
    return joined.groupBy(F.datediff("day", "first_day").alias("day_nr")).agg(
        F.sum("n").alias("n_events")
    )


def licence_family_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licences by subscription family (LIKE / =), total of
    named ones."""
    d = _domain(spark, sf_dir)
    per_sub = d.user_license.groupBy("org_subscription_id").agg(F.count(F.lit(1)).alias("n"))
    typed = per_sub.join(
        d.org_subscription.select("org_subscription_id", "subscription_type_id"), "org_subscription_id"
    ).join(d.subscription_type, "subscription_type_id")
    named = F.col("name").isNotNull()
    aggs = [F.coalesce(F.sum(F.when(named, F.col("n"))), F.lit(0)).cast("bigint").alias("count_all")]
    for col, fam in P.families.items():
        cond = named & matches_family("name", fam.prefixes, fam.names)
        aggs.append(F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("bigint").alias(col))
    return typed.agg(*aggs)


def plan_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``IS TRUE`` / ``IS FALSE`` on nullable plan flags, joined to
    the organisations they belong to."""
    d = _domain(spark, sf_dir)
    org = d.organization.select("organization_id", "billing_id")
    joined = org.join(d.plan_variant, F.col("billing_id") == F.col("customer_id"))
    return joined.groupBy(
        is_true("touchless").alias("touchless_true"), is_false("enterprise").alias("enterprise_false")
    ).agg(F.count(F.lit(1)).alias("n_orgs"))


def activity_group_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per activity of two named groups, concatenated in order
    without repeats, as a report's activity list."""
    d = _domain(spark, sf_dir)
    listed = P.groups.codes("cards", "visits")
    counts = d.user_activity.filter(F.col("activity").isin(listed)).groupBy("activity")
    return counts.agg(F.count(F.lit(1)).alias("n_events"))


SINGLE_OPS = {
    "calendar_spine_events": calendar_spine_events,
    "exclusion_list_counts": exclusion_list_counts,
    "exclusion_empty_list_counts": exclusion_empty_list_counts,
    "not_exists_activity_counts": not_exists_activity_counts,
    "json_text_values": json_text_values,
    "external_ids": external_ids,
    "heavy_users_having": heavy_users_having,
    "daily_conditional_distinct": daily_conditional_distinct,
    "org_filtered_counts": org_filtered_counts,
    "top_org_per_activity": top_org_per_activity,
    "daily_pairing": daily_pairing,
    "product_fold_other": product_fold_other,
    "org_error_share_band": org_error_share_band,
    "days_since_first_event": days_since_first_event,
    "licence_family_counts": licence_family_counts,
    "plan_flags": plan_flags,
    "activity_group_counts": activity_group_counts,
}
