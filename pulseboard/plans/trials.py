"""Trial reports: new trials vs the previous period (R2), trial usage by
trial day (R12, R13), by product (R14), top activities (R15), product mix
(R16)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseboard.functions.predicates import not_excluded, not_in_list_keep_null
from pulseboard.functions.text import fold_other, product_of
from pulseboard.functions.time import day_of, ts_lit
from pulseboard.operators.calendar import Series, attach_daily, day_spine
from pulseboard.operators.densify import densify_days
from pulseboard.operators.membership import may_be_in
from pulseboard.operators.multiplicity import multiplicity
from pulseboard.operators.period import pair_with_previous
from pulseboard.operators.rollup import rollup_activity, with_user_rule
from pulseboard.params import InternalRule, PeriodPair, ProductSpec, TrialSpec, as_datetime
from pulseboard.sources.bindings import Domain


# --------------------------------------------------------------------- R2
def new_trials_vs_previous(
    d: Domain,
    start,
    end,
    excluded_orgs: Iterable[int] = (),
    *,
    trial: TrialSpec = TrialSpec(),
) -> DataFrame:
    """R2. Distinct organisations whose trial began each day of the current
    period ``start+1 .. end`` (``new_trials``), paired with the day
    ``n_days`` earlier (``prev_day``, ``prev_new_trials``). Empty days
    count 0; ``end <= start`` gives an empty frame.
    """
    pair = PeriodPair.of(start, end)
    series = Series.days(pair.series_start, pair.last_day)
    subs = d.org_subscription.filter(
        (F.col("subscription_type_id") == trial.type_id)
        & F.col("valid_from").between(ts_lit(pair.series_start), ts_lit(pair.end))
        & not_excluded("organization_id", excluded_orgs)
    )
    per_day = subs.groupBy(day_of("valid_from").alias("day")).agg(
        F.count_distinct("organization_id").alias("new_trials")
    )
    spine = day_spine(d.spark, series)
    daily = attach_daily(spine, per_day, series).select(
        "day", F.coalesce("new_trials", F.lit(0)).cast("bigint").alias("new_trials")
    )
    return pair_with_previous(daily, pair, ["new_trials"]).orderBy("day")


# ---------------------------------------------------------------- R12, R13
def _trial_licences(d: Domain, start, end, trial: TrialSpec) -> DataFrame:
    """(user_id, trial_day, m): users licensed on a trial subscription that
    began after ``start`` and runs past ``end``; ``m`` = number of such
    licences with that start day (the fan-out of the licence join)."""
    subs = d.org_subscription.filter(
        (F.col("valid_until") > ts_lit(end))
        & (F.col("valid_from") > ts_lit(start))
        & (F.col("subscription_type_id") == trial.type_id)
    ).select("org_subscription_id", day_of("valid_from").alias("trial_day"))
    lic = d.user_license.select("user_id", "org_subscription_id")
    return multiplicity(lic.join(subs, "org_subscription_id"), ["user_id", "trial_day"], "m")


def _trial_day_rows(
    d: Domain, start, end, relevant: Iterable[str], key: Column, internal: InternalRule, trial: TrialSpec
) -> DataFrame:
    """Activity of trial licensees per (user, day, key): ``n`` events, ``m``
    licences, ``day_nr`` below ``trial.days``. The few licences cut the fact
    down before users are joined; on a fact bucketed by user already before it
    is rolled up.

    Days are in ``0 .. trial.days - 1``; those before a trial keep one row with
    NULLs, which lists their key. So a day meets the licences of its band
    and not all of its user's: both sides carry the number of a stretch of
    ``trial.days`` days, a licence that of its first day and the next.
    """
    start, end = as_datetime(start), as_datetime(end)
    licences = _trial_licences(d, start, end, trial)
    latest = licences.groupBy("user_id").agg(F.max("trial_day").alias("latest"))
    act = d.activity(start, end).filter(F.col("activity").isin(list(relevant)))
    if d.activity_by_user:
        act = act.join(latest.select("user_id"), "user_id", "left_semi")
    # the organisation matters only to a rule with an exempt one
    by_org = ["organization_id"] if internal is not None and internal.exempt_org is not None else []
    rolled = act.groupBy("user_id", *by_org, day_of("created").alias("day"), key).agg(
        F.count(F.lit(1)).alias("n")
    )
    # a day counts for some licence of its user if it does for the latest
    early = rolled.join(latest, "user_id").filter(F.datediff("day", "latest") < trial.days).drop("latest")
    if not by_org:
        early = early.withColumn("organization_id", F.lit(None).cast("bigint"))
    early = with_user_rule(early, d.user, internal).withColumn("stretch", _stretch("day", trial.days))
    first = _stretch("trial_day", trial.days)
    banded = licences.select(
        F.col("user_id").alias("licensee"), F.explode(F.array(first, first + 1)).alias("band"), "trial_day", "m"
    )
    day_nr = F.datediff("day", "trial_day")
    same = (F.col("user_id") == F.col("licensee")) & (F.col("stretch") == F.col("band"))
    rows = early.join(banded, same & (day_nr >= 0) & (day_nr < trial.days), "left")
    return rows.select(*early.columns, "m", day_nr.alias("day_nr"))


def _stretch(day: str, days: int) -> Column:
    return F.floor(F.unix_date(day) / days).cast("int")


def _trial_days_dense(key: str, value: DataFrame, trial: TrialSpec) -> DataFrame:
    """Shift day numbers to 1-based and densify to ``1..trial.days``; a NULL
    day lists its category only."""
    shifted = value.select((F.col("day_nr") + 1).alias("day_nr"), key, "act_count")
    return densify_days(shifted, key, "day_nr", "act_count", trial.days).orderBy("day_nr", key)


def trial_product_by_day(
    d: Domain,
    start,
    end,
    relevant: Iterable[str],
    *,
    internal: InternalRule,
    trial: TrialSpec = TrialSpec(),
) -> DataFrame:
    """R12. Distinct active trial users per trial day (1..14) and product,
    zero-filled for every product seen on a day below 14."""
    relevant = list(relevant)
    product = product_of("activity").alias("product_name")
    rows = _trial_day_rows(d, start, end, relevant, product, internal, trial)
    value = rows.groupBy("day_nr", "product_name").agg(F.count_distinct("user_id").alias("act_count"))
    return _trial_days_dense("product_name", value, trial)


def trial_activity_by_day(
    d: Domain,
    start,
    end,
    relevant: Iterable[str],
    *,
    internal: InternalRule,
    trial: TrialSpec = TrialSpec(),
) -> DataFrame:
    """R13. As R12 but ``count(*)`` of events per activity; an event counts
    once per matching trial licence (multiplicity ``m``)."""
    relevant = list(relevant)
    rows = _trial_day_rows(d, start, end, relevant, F.col("activity"), internal, trial)
    value = rows.groupBy("day_nr", "activity").agg(
        F.sum(F.col("n") * F.col("m")).cast("bigint").alias("act_count")
    )
    return _trial_days_dense("activity", value, trial)


# ---------------------------------------------------------- R14, R15, R16
def _trial_orgs(d: Domain, trial: TrialSpec) -> DataFrame:
    """(organization_id, m): organisations that ever had a subscription of
    the trial type name, ``m`` = rows of the organisation x trial join."""
    types = d.subscription_type.filter(F.col("name") == trial.type_name).select("subscription_type_id")
    trial_subs = d.org_subscription.select("organization_id", "subscription_type_id").join(
        types, "subscription_type_id"
    )
    orgs = multiplicity(d.organization.select("organization_id"), ["organization_id"], "org_rows")
    per_org = multiplicity(trial_subs, ["organization_id"], "sub_rows").join(orgs, "organization_id")
    return per_org.select("organization_id", (F.col("sub_rows") * F.col("org_rows")).alias("m"))


def _trial_activity(
    d: Domain, start, end, excluded_activities: Iterable[str], keys, aggs, internal: InternalRule, trial: TrialSpec
) -> DataFrame:
    """Rolled-up activity of trial organisations with their multiplicity ``m``.

    They are joined before the users, so users meet their rows only. On a
    stored fact a bounded set of them is tested at the scan as well: events of
    other organisations are neither rolled up nor exchanged.
    """
    start, end = as_datetime(start), as_datetime(end)
    trial_orgs = _trial_orgs(d, trial)
    act = d.activity(start, end).filter(not_in_list_keep_null("activity", excluded_activities))
    if d.stored_fact:
        act = act.filter(may_be_in("organization_id", trial_orgs, "organization_id"))
    rolled = rollup_activity(act, keys, aggs).join(trial_orgs, "organization_id")
    return with_user_rule(rolled, d.user, internal)


def trial_activity_by_product(
    d: Domain,
    start,
    end,
    excluded_activities: Iterable[str] = (),
    *,
    internal: InternalRule,
    trial: TrialSpec = TrialSpec(),
    products: ProductSpec = ProductSpec(),
) -> DataFrame:
    """R14. Events of trial organisations by product prefix; prefixes not in
    the product list fold into ``OTHER`` (always present, 0 if empty).
    Ascending by count."""
    rows = _trial_activity(
        d, start, end, excluded_activities,
        [product_of("activity").alias("product")], [F.count("activity").alias("n")], internal, trial,
    )
    per_label = rows.groupBy(fold_other("product", products.products, products.other).alias("product")).agg(
        F.sum(F.col("n") * F.col("m")).cast("bigint").alias("product_count")
    )
    other_row = d.spark.range(1).select(
        F.lit(products.other).alias("product"), F.lit(0).cast("bigint").alias("product_count")
    )
    out = per_label.unionByName(other_row)
    out = out.groupBy("product").agg(F.sum("product_count").cast("bigint").alias("product_count"))
    return out.orderBy("product_count", "product")


def trial_top_activities(
    d: Domain,
    start,
    end,
    excluded_activities: Iterable[str] = (),
    *,
    internal: InternalRule,
    trial: TrialSpec = TrialSpec(),
) -> DataFrame:
    """R15. Per activity of trial organisations: events ``activity_count``
    (once per trial row of the organisation) and distinct users; most
    frequent first. A NULL activity is kept (count 0)."""
    rows = _trial_activity(
        d, start, end, excluded_activities, ["activity"], [F.count("activity").alias("n")], internal, trial
    )
    # two levels give the sum and the exact distinct count in one pass
    per_user = rows.groupBy("activity", "user_id").agg(F.sum(F.col("n") * F.col("m")).alias("n"))
    out = per_user.groupBy("activity").agg(
        F.sum("n").cast("bigint").alias("activity_count"), F.count("user_id").alias("user_count")
    )
    return out.orderBy(F.col("activity_count").desc_nulls_first(), F.col("activity").asc_nulls_last())


def trial_product_mix(
    d: Domain,
    start,
    end,
    excluded_activities: Iterable[str] = (),
    *,
    internal: InternalRule,
    trial: TrialSpec = TrialSpec(),
    products: ProductSpec = ProductSpec(),
) -> DataFrame:
    """R16. Histogram of product combinations (``BCS+VR``) used by trial
    organisations, listed products only; organisations with none are left
    out. Most common first."""
    listed = sorted(set(products.products))
    product = product_of("activity")
    used = F.lit(0).cast("bigint")
    for k, name in enumerate(listed):
        used = F.when(product == name, F.lit(1 << k).cast("bigint")).otherwise(used)
    rows = _trial_activity(d, start, end, excluded_activities, [], [F.bit_or(used).alias("used")], internal, trial)
    # a set of listed products is one number, so both levels are plain hash aggregates
    per_org = rows.groupBy("organization_id").agg(F.bit_or("used").alias("used")).filter(F.col("used") != 0)
    held = [F.when(F.col("used").bitwiseAND(F.lit(1 << k)) != 0, F.lit(name)) for k, name in enumerate(listed)]
    mixes = per_org.select(F.concat_ws("+", *held).alias("product_mix")) if listed else per_org.select(F.lit("").alias("product_mix"))
    out = mixes.filter(F.col("product_mix") != "").groupBy("product_mix").agg(
        F.count(F.lit(1)).alias("org_count")
    )
    return out.orderBy(F.col("org_count").desc(), "product_mix")


__all__ = [
    "new_trials_vs_previous",
    "trial_activity_by_day",
    "trial_activity_by_product",
    "trial_product_by_day",
    "trial_product_mix",
    "trial_top_activities",
]
