"""Domain warehouse layouts: day-partitioned Parquet (pruned reads) and
bucketed catalog tables (no fact shuffle), against the test-table bindings."""

from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import functions as F

from pulseboard.plans.catalog import REPORTS, REPORTS_ON_DOMAIN, P, _domain
from pulseboard.plans.risk import slipping_away_orgs
from pulseboard.plans.usage import daily_active_orgs
from pulseboard.sources.bindings import domain_from_catalog, domain_from_parquet
from pulseboard.sources.warehouse import write_domain, write_domain_catalog
from tests.conftest import SF001, rows


@pytest.fixture(scope="module")
def layouts(spark):
    base = _domain(spark, SF001)
    root = "file://" + tempfile.mkdtemp(prefix="pulseboard-wh-")
    write_domain(base, root + "/parquet")
    write_domain_catalog(base, "pulseboard_test", root + "/catalog", buckets=4)
    return base, domain_from_parquet(spark, root + "/parquet"), domain_from_catalog(spark, "pulseboard_test")


def _files(df, day="2024-01-10"):
    """Files of the activity fact, in all and of one day."""
    names = [f for f in df.inputFiles()]
    return len(names), sum(f"event_date={day}/" in f for f in names)


def test_files_are_bounded_by_days_times_buckets_and_tasks(layouts):
    _, _, cat = layouts
    days = cat.user_activity.select("event_date").distinct().count()
    assert cat.activity_by_user
    assert _files(cat.user_activity)[0] <= days * 4 + 8


def test_a_heavy_day_is_written_by_several_tasks(spark, layouts):
    base, _, _ = layouts
    fact = base.user_activity.withColumn("created", F.expr("TIMESTAMP_NTZ '2024-01-10 00:00:00' + make_dt_interval(0, 0, 0, event_id)"))
    heavy = base.replace(user_activity=fact)
    root = "file://" + tempfile.mkdtemp(prefix="pulseboard-wh-")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the day is tiny here
    try:
        write_domain(heavy, root, day_splits=16)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    back = domain_from_parquet(spark, root)
    assert back.user_activity.count() == base.user_activity.count()
    assert 4 <= _files(back.user_activity)[1] <= 16


def test_rewriting_a_day_keeps_the_others(spark, layouts):
    base, _, _ = layouts
    root = "file://" + tempfile.mkdtemp(prefix="pulseboard-wh-")
    write_domain(base, root)
    with pytest.raises(Exception, match="already exists"):
        write_domain(base, root)
    one_day = F.to_date("created") == F.lit("2024-01-10").cast("date")
    write_domain(base.replace(user_activity=base.user_activity.filter(one_day)), root, mode="overwrite")
    assert domain_from_parquet(spark, root).user_activity.count() == base.user_activity.count()


def test_round_trip_and_partition_pruning(spark, layouts):
    _, wh, _ = layouts
    got = daily_active_orgs(wh, *P.r1, internal=P.internal, targets=P.targets)
    want = REPORTS["daily_active_orgs"](spark, SF001)
    assert rows(got) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    assert "event_date#" in plan and ">= 2024-01-20" in plan

    got5 = slipping_away_orgs(wh, P.as_of, P.grabber_group, internal=P.internal, cohort=P.cohort)
    assert sorted(rows(got5)) == sorted(rows(REPORTS["slipping_away_orgs"](spark, SF001)))


def _nodes(plan):
    yield plan
    for i in range(plan.children().size()):
        yield from _nodes(plan.children().apply(i))


def test_bucketed_catalog_layout_needs_no_fact_shuffle(spark, layouts):
    """Fact and users bucketed by user: the roll-up and the user join run
    without any exchange below the join (only aggregates are shuffled)."""
    _, _, cat = layouts
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = daily_active_orgs(cat, *P.r1, internal=P.internal, targets=P.targets)
        assert rows(got) == rows(REPORTS["daily_active_orgs"](spark, SF001))
        plan = got._jdf.queryExecution().executedPlan()
        plan = plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan
        joins = [n for n in _nodes(plan) if n.nodeName() == "SortMergeJoin"]
        assert joins, plan.toString()
        below = [n.nodeName() for n in _nodes(joins[0])]
        assert "Exchange" not in below, joins[0].toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_every_report_same_on_both_layouts(layouts):
    """Report builders give the same rows on the day-partitioned Parquet
    warehouse, on the bucketed catalog tables and on the test-table bindings."""
    base, parquet, catalog = layouts
    # every report on the Parquet warehouse; on the bucketed catalog the ones
    # whose joins the bucketing changes (user roll-ups, licences)
    bucketed = {"daily_active_orgs", "concurrent_license_exceeded", "daily_assigned_licenses", "trial_product_by_day"}
    for name, build in REPORTS_ON_DOMAIN.items():
        want = sorted(rows(build(base)), key=repr)
        assert sorted(rows(build(parquet)), key=repr) == want, name
        if name in bucketed:
            assert sorted(rows(build(catalog)), key=repr) == want, name
