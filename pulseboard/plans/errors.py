"""Error reports: organisation hit most per error type (R7), error detail on
a calendar (R8), counts per type (R9), drill-down (R10), one error per day
against the previous period (R11)."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulseboard.functions.predicates import keep_external, not_excluded
from pulseboard.functions.time import date_lit, day_of, format_utc, ts_lit
from pulseboard.operators.calendar import Series, attach_daily, attach_detail, day_spine
from pulseboard.operators.period import pair_by_position, pair_with_previous
from pulseboard.operators.rollup import rollup_activity, with_user_rule
from pulseboard.operators.topk import top1_per_group
from pulseboard.params import InternalRule, PeriodPair, as_datetime
from pulseboard.sources.bindings import Domain

META_KEY = "meta"
DETAIL_COLUMNS = (
    "day", "user_id", "username", "org_id", "org_name", "activity",
    "meta", "interval_var", "date", "hs_org_id", "bw_org_id",
)


# --------------------------------------------------------------------- R7
def top_org_per_error(
    d: Domain,
    start,
    end,
    error_activities: Iterable[str],
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
) -> DataFrame:
    """R7. For each error activity the organisation with the most events
    (``act_count``; ties: smaller org id, then ids), its last event time."""
    start, end = as_datetime(start), as_datetime(end)
    act = d.counted(start, end).filter(
        F.col("activity").isin(list(error_activities)) & not_excluded("organization_id", excluded_orgs)
    )
    rolled = rollup_activity(act, ["activity"], [F.sum("n").alias("n"), F.max("last_at").alias("last_act")])
    kept = with_user_rule(rolled, d.user, internal)
    per_org = kept.groupBy("activity", "organization_id").agg(
        F.sum("n").alias("n"), F.max("last_act").alias("last_act")
    )
    ext = d.org_ext_weighted
    ranked = per_org.join(ext, "organization_id").select(
        "activity",
        F.col("organization_id").alias("org_id"),
        (F.col("n") * F.col("ext_mult")).cast("bigint").alias("act_count"),
        "last_act",
        "org_name",
        "hs_org_id",
        "bw_org_id",
    )
    top = top1_per_group(
        ranked,
        ["activity"],
        [
            F.col("act_count").desc(),
            F.col("org_id").asc(),
            F.col("hs_org_id").asc_nulls_first(),
            F.col("bw_org_id").asc_nulls_first(),
        ],
    )
    return top.orderBy(F.col("act_count").desc_nulls_first(), "activity")


# ------------------------------------------------------------- R8 .. R10
def _error_activity(d: Domain, pair: PeriodPair, error_activities, excluded_orgs) -> DataFrame:
    """Error events of both periods (``series_start <= created <= end``)."""
    return d.activity(pair.series_start, pair.end).filter(
        F.col("activity").isin(list(error_activities)) & not_excluded("organization_id", excluded_orgs)
    )


def error_rows(
    d: Domain,
    start,
    end,
    error_activities: Iterable[str],
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    meta_key: str = META_KEY,
) -> DataFrame:
    """Error events of the current and previous period with user,
    organisation, JSON ``meta``, period flag ``interval_var`` (1 after
    ``start``, 0 up to it) and a formatted time. No calendar rows."""
    pair = PeriodPair.of(start, end)
    act = _error_activity(d, pair, error_activities, excluded_orgs)
    users = d.user.select(F.col("user_id").alias("usr_user_id"), "username")
    rows = act.join(users, act.user_id == users.usr_user_id, "left").filter(
        keep_external("organization_id", "username", internal)
    )
    ext = d.org_ext.withColumnRenamed("organization_id", "org_id")
    rows = rows.join(ext, rows.organization_id == ext.org_id, "left")
    return rows.select(
        day_of("created").alias("day"),
        F.col("usr_user_id").alias("user_id"),
        "username",
        "org_id",
        "org_name",
        "activity",
        F.get_json_object("payload", f"$.{meta_key}").alias("meta"),
        F.when(F.col("created") > ts_lit(pair.start), F.lit(1))
        .when(F.col("created") <= ts_lit(pair.start), F.lit(0))
        .alias("interval_var"),
        format_utc("created").alias("date"),
        "hs_org_id",
        "bw_org_id",
    )


def error_detail(
    d: Domain,
    start,
    end,
    error_activities: Iterable[str],
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    meta_key: str = META_KEY,
    total_order: bool = False,
) -> DataFrame:
    """R8. :func:`error_rows` on the calendar of both periods: days without
    errors get one blank row (activity ``''``, other columns NULL).

    Ordered by day. ``total_order`` also orders the rows of a day (by time,
    organisation, user, activity)."""
    pair = PeriodPair.of(start, end)
    series = Series.days(pair.series_start, pair.last_day)
    rows = error_rows(
        d, start, end, error_activities, excluded_orgs, internal=internal, meta_key=meta_key
    )
    # days that have rows, from a roll-up per (user, organisation, day): the
    # same rule and filters as the detail, without moving every error row
    act = _error_activity(d, pair, error_activities, excluded_orgs)
    rolled = rollup_activity(act, [day_of("created").alias("day")], [F.count(F.lit(1)).alias("n")])
    present = with_user_rule(rolled, d.user, internal, how="left").select("day")
    spine = day_spine(d.spark, series)
    out = attach_detail(spine, rows, series, present=present).withColumn(
        "activity", F.coalesce("activity", F.lit(""))
    )
    # the time splits a heavy day across the range partitions of the sort
    order = ("day", "date", "org_id", "user_id", "activity") if total_order else ("day", "date")
    return out.select(*DETAIL_COLUMNS).orderBy(*order)


def _weighted_error_counts(
    d: Domain, act: DataFrame, key: Column, name: str, internal: InternalRule
) -> DataFrame:
    """Error counts per (organisation, key) with the detail's user rule; only
    those few rows meet the fan-out of the organisation/profile left joins."""
    rolled = rollup_activity(act, [key.alias(name)], [F.count(F.lit(1)).alias("n")])
    kept = with_user_rule(rolled, d.user, internal, how="left")
    per_org = kept.groupBy("organization_id", name).agg(F.sum("n").alias("n"))
    weighted = per_org.join(d.org_row_mult, "organization_id", "left")
    return weighted.withColumn("w", (F.col("n") * F.coalesce("ext_mult", F.lit(1))).cast("bigint"))


def error_counts(
    d: Domain,
    start,
    end,
    error_activities: Iterable[str],
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
) -> DataFrame:
    """R9. Current-period detail rows per error activity, most first (ties by
    name). Same numbers as counting R8's rows with ``interval_var = 1``,
    but the fact is rolled up per user before any join."""
    pair = PeriodPair.of(start, end)
    act = _error_activity(d, pair, error_activities, excluded_orgs).filter(
        F.col("created") > ts_lit(pair.start)
    )
    counts = _weighted_error_counts(d, act, F.col("activity"), "activity", internal)
    out = counts.groupBy("activity").agg(F.sum("w").cast("bigint").alias("error_count"))
    return out.orderBy(F.col("error_count").desc(), "activity")


def error_events(
    d: Domain,
    start,
    end,
    error_activities: Iterable[str],
    error_type: str,
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    meta_key: str = META_KEY,
) -> DataFrame:
    """R10. Drill-down: current-period detail rows of one error type."""
    listed = [a for a in error_activities if a == error_type]
    rows = error_rows(d, start, end, listed, excluded_orgs, internal=internal, meta_key=meta_key)
    return rows.filter(F.col("interval_var") == 1).select(*DETAIL_COLUMNS).orderBy(
        "day", "date", "org_id", "user_id"
    )


def error_daily_vs_previous(
    d: Domain,
    start,
    end,
    error_activities: Iterable[str],
    error_type: str,
    excluded_orgs: Iterable[int] = (),
    *,
    internal: InternalRule,
    every_day: bool = False,
) -> DataFrame:
    """R11. Events of one error type per current day (``error_count``) next to
    a day of the previous period (``prev_day``, ``prev_error_count``).

    The current series is ``start+1 .. end-1``, zero-filled, and ``end`` where
    it has events. The previous series is the ``n_days - 1`` days before
    ``start``, of which the first counts only where it has events and the
    others are zero-filled, and then ``start`` with its events after ``start``.
    Both are paired by position; a current day without a partner keeps NULLs.

    ``every_day`` instead zero-fills every day of both periods, so that each
    day pairs with the one ``n_days`` earlier.
    """
    pair = PeriodPair.of(start, end)
    series = Series.days(pair.series_start, pair.last_day)
    listed = [a for a in error_activities if a == error_type]
    act = _error_activity(d, pair, listed, excluded_orgs).filter(
        ~((F.col("created") <= ts_lit(pair.start)) & (day_of("created") >= F.lit(pair.start.date())))
    )
    counts = _weighted_error_counts(d, act, day_of("created"), "day", internal)
    per_day = counts.groupBy("day").agg(F.sum("w").cast("bigint").alias("error_count"))
    daily = attach_daily(day_spine(d.spark, series), per_day, series)
    filled = F.coalesce("error_count", F.lit(0)).cast("bigint").alias("error_count")
    if every_day:
        return pair_with_previous(daily.select("day", filled), pair, ["error_count"]).orderBy("day")
    day, seen = F.col("day"), F.col("error_count").isNotNull()
    first, last = date_lit(pair.series_start), date_lit(pair.last_day)
    # without its first day the previous series moves up by one; 2 n_days rows
    whole = Window.partitionBy(F.lit(0))
    moved = F.when(F.lit(pair.n_days < 2), F.lit(0)).otherwise(
        F.coalesce(F.max(F.when((day == first) & ~seen, F.lit(1))).over(whole), F.lit(0))
    )
    previous = day <= date_lit(pair.start)
    daily = daily.select("day", filled, seen.alias("seen"), moved.alias("moved"))
    daily = daily.filter(
        (previous & ((F.col("moved") == 0) | (day != first))) | (~previous & ((day != last) | F.col("seen")))
    )
    shift = F.lit(pair.n_days) - F.when(F.lit(pair.n_days < 2), F.lit(0)).otherwise(F.col("moved"))
    return pair_by_position(daily, previous, F.date_add(day, shift), ["error_count"]).orderBy("day")
