"""Lazy frames, published versions, row-group pruning, the stored roll-up and the daily bitmaps."""

from __future__ import annotations

import glob
import os
import tempfile
from datetime import date

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from pulseboard.params import InternalRule
from pulseboard.plans import usage
from pulseboard.plans.catalog import REPORTS, REPORTS_ON_DOMAIN, P, _domain
from pulseboard.sources import versions, warehouse
from pulseboard.sources.bindings import Domain, domain_from_catalog, domain_from_parquet
from pulseboard.sources.daily import (
    activity_counts,
    daily_distinct,
    merged_distinct,
    read_activity_counts,
    read_daily_distinct,
    write_activity_counts,
    write_daily_distinct,
)
from tests.conftest import SF001, SF01, rows, ts


def folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="pulseboard-store-")


# --------------------------------------------------------------- lazy frames
@pytest.mark.parametrize(
    "name, tables",
    [
        ("daily_active_orgs", {"user_activity", "user"}),
        ("new_trials_vs_previous", {"org_subscription"}),
        ("daily_assigned_licenses", {"user_license", "org_subscription", "subscription_type"}),
        ("trial_top_activities", {"user_activity", "user", "organization", "org_subscription", "subscription_type"}),
    ],
)
def test_a_report_makes_only_the_frames_it_reads(spark, name, tables):
    d = _domain(spark, SF001)
    assert d.made == set()
    REPORTS_ON_DOMAIN[name](d)
    assert d.made == tables


def test_domain_wants_every_table(spark):
    with pytest.raises(TypeError, match="exactly the tables"):
        Domain(user=lambda: spark.range(1))
    with pytest.raises(AttributeError):
        _domain(spark, SF001).no_such_table


# ------------------------------------------------------- versions, row groups
def test_a_killed_write_leaves_the_version_before(spark, monkeypatch):
    base, root = _domain(spark, SF001), folder()
    write = warehouse.write_domain
    write(base, root)
    before = rows(REPORTS_ON_DOMAIN["daily_active_orgs"](domain_from_parquet(spark, root)))
    assert before == rows(REPORTS["daily_active_orgs"](spark, SF001))

    def killed(*args):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(warehouse, "publish", killed)
        with pytest.raises(KeyboardInterrupt):
            write(base.replace(user_activity=base.user_activity.limit(0), user=base.user.limit(0)), root, mode="overwrite")
    assert rows(REPORTS_ON_DOMAIN["daily_active_orgs"](domain_from_parquet(spark, root))) == before
    assert [n for n in versions.listed(spark, f"{root}/{versions.MANIFESTS}") if not n.startswith(".")].__len__() == 1
    # the next write publishes, and what no version names can go
    kept = write(base, root, mode="overwrite")
    gone = versions.drop_old_runs(spark, root, keep=1)
    assert gone and not any(kept in g for g in gone)
    assert domain_from_parquet(spark, root).user_activity.count() == base.user_activity.count()
    assert versions.drop_old_runs(spark, folder()) == []


def test_a_domain_without_versions_is_not_written_over(spark):
    base, root = _domain(spark, SF001), folder()
    for name in ("user_activity", "user"):
        getattr(base, name).write.parquet(f"{root}/{name}")
    with pytest.raises(FileExistsError, match="already exists"):
        warehouse.write_domain(base, root)
    assert domain_from_parquet(spark, root, activity_day_col=None).user_activity.count() == base.user_activity.count()


def test_days_of_earlier_runs_stay(spark):
    base, root = _domain(spark, SF001), folder()
    first = warehouse.write_domain(base, root)
    one_day = F.to_date("created") == F.lit("2024-01-10").cast("date")
    second = warehouse.write_domain(base.replace(user_activity=base.user_activity.filter(one_day).limit(3)), root, mode="overwrite")
    version = versions.current_version(spark, root)
    assert version.days["2024-01-10"] == second and version.days["2024-01-11"] == first
    back = domain_from_parquet(spark, root).user_activity
    assert back.filter(one_day).count() == 3 and back.filter(~one_day).count() == base.user_activity.filter(~one_day).count()


def _scanned(df) -> int:
    """Rows that the scans of the activity fact hand on."""
    df.collect()

    def nodes(plan):
        yield plan
        if "QueryStage" in plan.nodeName():
            yield from nodes(plan.plan())
        for i in range(plan.children().size()):
            yield from nodes(plan.children().apply(i))

    plan = df._jdf.queryExecution().executedPlan()
    final = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
    scans = [n for n in nodes(final) if "Scan" in n.nodeName() and "created" in n.toString()]
    return sum(n.metrics().get("numOutputRows").get().value() for n in scans)


def test_row_groups_of_other_activities_are_skipped(spark):
    """The sorted day files have several row groups, and a report on one code reads few of them."""
    base, root = _domain(spark, SF01), folder()
    one_day = F.to_timestamp_ntz(F.lit("2024-01-10 00:00:00"))
    big = base.replace(user_activity=base.user_activity.withColumn("created", one_day))
    size = spark.sparkContext._jsc.hadoopConfiguration()
    keys = {"parquet.block.size": "16384", "parquet.block.size.row.check.min": "100", "parquet.page.size.row.check.min": "100"}
    old = {k: size.get(k) for k in keys}
    for k, v in keys.items():
        size.set(k, v)
    try:
        warehouse.write_domain(big, root, day_splits=1)
    finally:
        for k, v in old.items():
            size.unset(k) if v is None else size.set(k, v)
    files = glob.glob(f"{root[7:]}/user_activity/run=*/event_date=*/*.parquet")
    groups = [pq.ParquetFile(f).metadata for f in files]
    total = sum(m.num_row_groups for m in groups)
    assert total >= 8
    at = pq.ParquetFile(files[0]).schema_arrow.names.index("activity")
    hit = [s for m in groups for g in range(m.num_row_groups) if (s := m.row_group(g).column(at).statistics) and s.has_min_max and s.min <= "VR_VIEW" <= s.max]
    assert len(hit) <= total // 3
    fact = domain_from_parquet(spark, root).user_activity
    wanted = fact.filter(F.col("activity") == "VR_VIEW").select("user_id", "created")
    assert _scanned(wanted) <= fact.count() // 3
    assert wanted.count() == base.user_activity.filter(F.col("activity") == "VR_VIEW").count()


def test_a_heavy_day_and_user_is_written_by_several_tasks(spark):
    base, root = _domain(spark, SF01), folder()
    hot = F.when(F.col("event_id") % 3 == 0, F.lit(5).cast("bigint")).otherwise(F.col("user_id"))
    day = F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00' + make_dt_interval(0, 0, 0, event_id)")
    heavy = base.replace(user_activity=base.user_activity.withColumn("user_id", hot).withColumn("created", day))
    n = heavy.user_activity.count()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the day is tiny here
    try:
        warehouse.write_domain_catalog(heavy, "pulseboard_heavy", root, buckets=4, tasks=12)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = domain_from_catalog(spark, "pulseboard_heavy")
    files = back.user_activity.filter(F.col("user_id") == 5).select(F.input_file_name().alias("f")).distinct().count()
    assert back.activity_by_user and files >= 4
    assert back.user_activity.count() == n
    assert len(glob.glob(f"{root[7:]}/user_activity/*/*.parquet")) <= 4 * back.user_activity.select("event_date").distinct().count() + 12
    got = REPORTS_ON_DOMAIN["daily_active_orgs"](back)
    assert rows(got) == rows(REPORTS_ON_DOMAIN["daily_active_orgs"](heavy))


# -------------------------------------------------------------- daily roll-up
BY_COUNTS = ["daily_active_orgs", "daily_active_orgs_excluded", "daily_active_orgs_midday_end", "most_active_touchless_orgs", "slipping_away_orgs", "top_org_per_error"]


def test_reports_from_the_rollup_equal_those_from_the_fact(spark):
    root = folder()
    d = _domain(spark, SF01)
    write_activity_counts(d, root)
    stored = d.replace(activity_counts=lambda: read_activity_counts(spark, root))
    for name in BY_COUNTS:
        build = REPORTS_ON_DOMAIN[name]
        assert sorted(rows(build(stored)), key=repr) == sorted(rows(build(d)), key=repr), name


def test_writing_a_day_again_changes_nothing_and_takes_in_late_events(spark):
    root = folder()
    d = _domain(spark, SF001)
    write_activity_counts(d, root)
    want = sorted(rows(activity_counts(d)), key=repr)
    assert sorted(rows(read_activity_counts(spark, root)), key=repr) == want
    days = [date(2024, 1, 10), date(2024, 1, 12)]
    write_activity_counts(d, root, days)
    assert sorted(rows(read_activity_counts(spark, root)), key=repr) == want
    late = spark.createDataFrame([(10**9, 3, 0, "BCS_CLICK", ts("2024-01-12 23:59:59"), None)], d.user_activity.schema)
    write_activity_counts(d.replace(user_activity=d.user_activity.unionByName(late)), root, days)
    assert read_activity_counts(spark, root).agg(F.sum("n")).first()[0] == d.user_activity.count() + 1


@pytest.mark.parametrize(
    "lo, hi, strict",
    [
        ("2024-01-10", "2024-01-12", False), ("2024-01-10", "2024-01-12", True), ("2024-01-10 06:00:00", "2024-01-12 18:30:00", False),
        ("2024-01-10 06:00:00", "2024-01-10 18:00:00", False), ("2024-01-10", "2024-01-10", False), ("2024-01-12", "2024-01-10", False),
        ("2024-01-10 06:00:00", None, True), (None, None, False), (None, "2024-01-10 06:00:00", False), ("2024-01-10 06:00:00", "2024-01-11 01:00:00", False),
    ],
)
def test_part_days_come_from_the_fact(spark, lo, hi, strict):
    d = _domain(spark, SF01)
    sometimes = F.when(F.col("event_id") % 41 != 0, F.col("created"))  # a time is unknown now and then
    d = d.replace(user_activity=d.user_activity.withColumn("created", sometimes))
    stored = d.replace(activity_counts=activity_counts(d))
    total = lambda df: sorted(rows(df.groupBy("user_id", "organization_id", "activity", "day").agg(F.sum("n"), F.max("last_at"))), key=repr)
    assert total(stored.counted(lo, hi, strict)) == total(d.counted(lo, hi, strict))


def test_whole_days_do_not_read_the_fact(spark):
    d = _domain(spark, SF001)
    stored = d.replace(activity_counts=spark.createDataFrame([], activity_counts(d).schema))
    assert stored.counted("2024-01-10", None).count() == 0 and "user_activity" not in stored.made


# -------------------------------------------------------------------- bitmaps
def test_merged_sets_give_exact_distinct_counts(spark, dom):
    events = [
        (1, 10, 2, "A_X", ts("2024-01-01 10:00:00"), None), (2, 10, 2, "A_X", ts("2024-01-02 10:00:00"), None),
        (3, 11, 70_000, "A_X", ts("2024-01-02 11:00:00"), None), (4, 11, 70_000, "B_X", ts("2024-01-02 12:00:00"), None),
        (5, 12, -5, "B_X", ts("2024-01-01 12:00:00"), None), (6, 12, None, "B_X", ts("2024-01-01 12:00:00"), None),
        (7, 13, 9, "A_X", ts("2024-01-01 12:00:00"), None), (8, None, 2, "C_X", ts("2024-01-01 12:00:00"), None),
        (9, 13, 1, "A_X", ts("2024-01-01 12:00:00"), None),
    ]
    users = [(10, "a@x", 2, False), (11, "b@x", 3, False), (12, "c@x", 4, False), (13, "d@corp", 1, False)]
    d = dom.make(user_activity=events, user=users)
    root = folder()
    write_daily_distinct(d, root, internal=InternalRule("%@corp", 1))
    sets = read_daily_distinct(spark, root)
    day = rows(merged_distinct(sets, ["day"], {"n": None, "a": F.col("activity") == "A_X"}).orderBy("day"))
    assert day == [(date(2024, 1, 1), 3, 2), (date(2024, 1, 2), 2, 2)]
    assert rows(merged_distinct(sets, [], {"n": None, "b": F.col("activity") == "B_X", "none": F.lit(False)})) == [(4, 2, 0)]
    assert rows(merged_distinct(daily_distinct(d, "user_id"), ["activity"], {"n": None}).orderBy("activity")) == [("A_X", 3), ("B_X", 2)]
    write_daily_distinct(d, root, [date(2024, 1, 2)], internal=InternalRule("%@corp", 1))
    assert rows(merged_distinct(read_daily_distinct(spark, root), [], {"n": None})) == [(4,)]


def test_days_merge_without_the_fact(spark):
    """Two days merged equal the two-level distinct count over both."""
    d, root = _domain(spark, SF01), folder()
    write_daily_distinct(d, root, activities=P.targets.codes.values(), internal=P.internal)
    sets = read_daily_distinct(spark, root)
    got = rows(usage.active_orgs_of_window(sets, date(2024, 1, 20), date(2024, 1, 21), targets=P.targets))
    codes = list(P.targets.codes.values())
    kept = d.activity("2024-01-20", "2024-01-21 23:59:59.999999").filter(F.col("activity").isin(codes)).join(d.user.select("user_id", "username"), "user_id")
    kept = kept.filter((F.col("organization_id") == P.internal.exempt_org) | ~F.col("username").like(P.internal.pattern))
    want = kept.agg(F.count_distinct("organization_id"), *[F.count_distinct(F.when(F.col("activity") == c, F.col("organization_id"))) for c in codes])
    assert got == rows(want) and got[0][0] > 0
    empty = usage.active_orgs_of_window(sets, date(2030, 1, 1), date(2030, 1, 2), targets=P.targets)
    assert rows(empty) == [(0, 0, 0, 0)]
    plan = usage.active_orgs_of_days(sets, *P.whole_days, targets=P.targets)._jdf.queryExecution().optimizedPlan().toString()
    assert os.path.basename(SF01) not in plan and "user_id" not in plan
