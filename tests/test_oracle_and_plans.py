"""Registered queries against DuckDB, result properties, and plan shape."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import entry, oracle_sql, queries
from duck_oracle import reports, single_ops
from pulseboard.plans.catalog import REPORTS
from pulseboard.plans.single_ops import SINGLE_OPS
from pulseboard.plans.stored import STORED_RUNS
from tests.conftest import SF001, SF01
from tests.oracle_check import compare, duck_connect

QUERIES = {**REPORTS, **SINGLE_OPS}
ORACLE = {**reports.build(), **single_ops.build()}


@pytest.fixture(scope="module")
def con001():
    return duck_connect(SF001)


def test_every_query_has_an_oracle():
    missing = sorted({*QUERIES, *STORED_RUNS} - set(ORACLE))
    assert missing == []
    assert {*QUERIES, *STORED_RUNS} <= set(queries()) and set(ORACLE) <= set(oracle_sql())


def test_building_a_report_starts_no_job(spark):
    sc = spark.sparkContext
    sc.setJobGroup("building", "report builders are lazy")
    try:
        for build in QUERIES.values():
            build(spark, SF001)
        assert list(sc.statusTracker().getJobIdsForGroup("building")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_appended_files_are_seen(spark, tmp_path):
    for name in ("customer", "orders", "lineitem", "supplier"):
        spark.read.parquet(f"{SF001}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    events = spark.read.parquet(f"{SF001}/events.parquet")
    events.write.parquet(f"{tmp_path}/events.parquet")
    count = QUERIES["json_text_values"]
    before = count(spark, str(tmp_path)).agg(F.sum("n_events")).first()[0]
    events.write.mode("append").parquet(f"{tmp_path}/events.parquet")
    assert count(spark, str(tmp_path)).agg(F.sum("n_events")).first()[0] == 2 * before


def test_rows_that_only_null_rules_give(spark):
    """Unknown organisations, activities, flags and users all meet the data."""
    q = lambda name: QUERIES[name](spark, SF001)
    assert q("exclusion_empty_list_counts").filter("organization_id IS NULL").count() == 1
    assert q("exclusion_list_counts").filter("organization_id IS NULL").count() == 0
    assert q("not_exists_activity_counts").filter("activity IS NULL").count() == 1
    assert q("plan_flags").filter("NOT touchless_true AND NOT enterprise_false").count() == 1
    ids = QUERIES["external_ids"](spark, SF01)
    assert ids.filter("bw_org_id IS NULL").count() > 0 and ids.filter("hs_org_id IS NULL").count() > 0
    detail = QUERIES["error_detail"](spark, SF01)
    assert detail.filter("user_id IS NULL AND activity <> ''").count() > 0


@pytest.mark.parametrize("name", sorted({**QUERIES, **STORED_RUNS}))
def test_matches_duckdb_sf0001(spark, con001, name):
    r = compare(spark, con001, name, {**QUERIES, **STORED_RUNS}[name], ORACLE[name], SF001)
    assert r["cols_match"], (r["spark_cols"], r["duck_cols"])
    assert r["rows"][0] == r["rows"][1]
    assert r["hash"][0] == r["hash"][1]


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.columns == ["day", "total_orga_count", "cs_orga_count", "vr_orga_count", "dq_orga_count"]
    assert df.count() == 15


# ------------------------------------------------------------- properties
def _q(spark, name, sf=SF01):
    return QUERIES[name](spark, sf)


def test_spine_has_one_row_per_day(spark):
    df = _q(spark, "daily_active_orgs")
    assert df.count() == df.select("day").distinct().count() == 15


def test_product_counts_below_total(spark):
    df = _q(spark, "daily_active_orgs").na.fill(0)
    assert df.filter(
        (F.col("cs_orga_count") > F.col("total_orga_count"))
        | (F.col("vr_orga_count") > F.col("total_orga_count"))
        | (F.col("dq_orga_count") > F.col("total_orga_count"))
    ).count() == 0


def test_one_row_per_error_type(spark):
    df = _q(spark, "top_org_per_error")
    assert df.count() == df.select("activity").distinct().count()


def test_r14_and_r15_count_the_same_rows(spark):
    a = _q(spark, "trial_activity_by_product").agg(F.sum("product_count")).first()[0]
    b = _q(spark, "trial_top_activities").agg(F.sum("activity_count")).first()[0]
    assert a == b and a > 0


def test_r12_is_dense(spark):
    df = _q(spark, "trial_product_by_day")
    products = df.select("product_name").distinct().count()
    assert df.count() == 14 * products
    assert df.agg(F.min("day_nr"), F.max("day_nr")).first() == (1, 14)


def test_r16_not_more_mixes_than_trial_orgs(spark):
    total = _q(spark, "trial_product_mix").agg(F.sum("org_count")).first()[0]
    assert 0 < total <= spark.read.parquet(f"{SF01}/customer.parquet").count() // 10 + 1


# ------------------------------------------------------------------ plans
def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_top1_uses_window_group_limit(spark):
    assert "WindowGroupLimit" in _plan(_q(spark, "top_org_per_error"))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_udf(spark, name):
    plan = _plan(_q(spark, name))
    for marker in ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert marker not in plan


def test_time_range_reaches_the_scan(spark):
    df = _q(spark, "daily_active_orgs")
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024-01-20T00:00)" in text
    assert "LessThanOrEqual(ts,2024-02-03T00:00)" in text


def _plan_nodes(plan):
    yield plan
    if "QueryStage" in plan.nodeName():
        yield from _plan_nodes(plan.plan())
    for i in range(plan.children().size()):
        yield from _plan_nodes(plan.children().apply(i))


def _final(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    return plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def _join_rows(df) -> list[int]:
    metrics = [n.metrics().get("numOutputRows") for n in _plan_nodes(_final(df)) if "Join" in n.nodeName()]
    return [m.get().value() for m in metrics if m.isDefined()]


def test_trial_join_does_not_fan_out(spark):
    """R14 joins rolled-up activity with one multiplicity row per trial
    organisation: no join emits more rows than the largest table read (the
    naive fan-out join emits ~1.2M rows from 10k events at sf0.01)."""
    outputs = _join_rows(_q(spark, "trial_activity_by_product"))
    largest_input = max(
        spark.read.parquet(f"{SF01}/{t}.parquet").count() for t in ("events", "orders", "customer")
    )
    assert outputs and max(outputs) <= largest_input, outputs


@pytest.mark.parametrize("name", ["trial_product_by_day", "trial_activity_by_day"])
def test_trial_days_meet_the_licences_of_their_band_only(spark, dom, name):
    """A user with a trial licence on each of 400 days and an event a day: the
    join gives 14 licences a day and not all those of the user."""
    from datetime import datetime, timedelta

    from pulseboard.plans import trials
    from tests.conftest import rows

    day0, n = datetime(2024, 1, 1), 400
    later = day0 + timedelta(days=10 * n)
    d = dom.make(
        user_activity=[(k, 1, 2, "BCS_X", day0 + timedelta(days=k, hours=1), None) for k in range(n)],
        user=[(1, "a@x", 2, False)],
        org_subscription=[(k, 2, 16, 1, day0 + timedelta(days=k), later) for k in range(n)],
        user_license=[(1, k, day0, None) for k in range(n)],
    )
    df = getattr(trials, name)(d, day0 - timedelta(days=1), day0 + timedelta(days=n), ["BCS_X"], internal=None)
    assert rows(df)[0][2] == (1 if name == "trial_product_by_day" else n)
    assert max(_join_rows(df)) <= 15 * n


@pytest.mark.parametrize(
    "name", ["trial_top_activities", "error_daily_vs_previous", "error_daily_vs_previous_every_day", "trial_product_mix", "daily_active_orgs"]
)
def test_one_scan_of_the_fact(spark, name):
    """The report's plan, without stage reuse, reads the events once."""
    plan = _q(spark, name)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("event_type#") and plan.count("Relation [event_id") == 1, plan


def test_new_trials_scan_subscriptions_once(spark):
    plan = _q(spark, "new_trials_vs_previous")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1, plan


def test_product_mix_is_a_plain_hash_aggregate(spark):
    plan = _plan(_q(spark, "trial_product_mix"))
    assert "HashAggregate" in plan and "ObjectHashAggregate" not in plan and "collect_set" not in plan


@pytest.mark.parametrize("name", ["trial_activity_by_product", "trial_top_activities", "trial_product_mix"])
def test_trial_organisations_restrict_a_stored_fact_at_the_scan(spark, name):
    """On a stored fact, events of other organisations are dropped below the roll-up and its exchange."""
    from pulseboard.plans.catalog import REPORTS_ON_DOMAIN, _domain

    d = _domain(spark, SF01)
    stored = d.replace(stored_fact=True)
    build = REPORTS_ON_DOMAIN[name]
    assert sorted(map(tuple, build(stored).collect()), key=repr) == sorted(map(tuple, build(d).collect()), key=repr)
    text = build(stored)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    rolled = next(k for k, line in enumerate(text) if "Aggregate [user_id" in line)
    held = next(k for k, line in enumerate(text) if "scalar-subquery" in line and "getbit" in line.lower())
    scan = next(k for k, line in enumerate(text) if "Relation [event_id" in line)
    assert rolled < held < scan, "\n".join(text)


def test_membership_filter_keeps_members_and_few_others(spark):
    from pulseboard.operators.membership import may_be_in

    keys = spark.range(0, 1000, 7).withColumnRenamed("id", "k").union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    rows = spark.range(1000).union(spark.sql("SELECT CAST(NULL AS BIGINT)"))
    kept = {r.id for r in rows.filter(may_be_in("id", keys, "k", bits=1 << 14)).collect()}
    assert set(range(0, 1000, 7)) <= kept and len(kept) < 200 and None not in kept
    assert rows.filter(may_be_in("id", keys, "k", bits=64)).count() >= 143  # far too few bits: nothing is lost
    assert rows.filter(may_be_in("id", keys.limit(0), "k")).count() == 0


@pytest.mark.parametrize(
    "name, broadcasts",
    [("error_detail", 1), ("error_counts", 0), ("trial_activity_by_product", 0), ("daily_active_orgs", 1)],
)
def test_only_calendars_are_broadcast_on_purpose(spark, name, broadcasts):
    """With automatic broadcasting off, only frames bounded by report parameters still are."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    old = {k: spark.conf.get(k) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    try:
        plan = _plan(_q(spark, name))
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert plan.count("BroadcastHashJoin") == broadcasts, plan


def _initial(df):
    plan = df._jdf.queryExecution().executedPlan()
    return plan.initialPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan


def _reads(node, column: str) -> bool:
    """Whether a scan below the node has the column."""
    return any("Scan" in n.nodeName() and column in n.toString().split("ReadSchema")[-1] for n in _plan_nodes(node))


def _joins_above(plan, columns) -> list[str]:
    """Of the given scan columns, the order in which joins bring them to the events, the first first."""
    found = []
    for node in _plan_nodes(plan):
        if "Join" in node.nodeName():
            sides = [node.children().apply(i) for i in range(node.children().size())]
            facts = [_reads(x, "event_type") for x in sides]
            if sum(facts) == 1:
                other = sides[facts.index(False)]
                found.append(next((c for c in columns if _reads(other, c)), ""))
    return [c for c in reversed(found) if c]


@pytest.mark.parametrize(
    "name, first",
    [("trial_product_by_day", "o_orderpriority"), ("trial_activity_by_day", "o_orderpriority")],
)
def test_licences_restrict_before_users_are_joined(spark, name, first):
    order = _joins_above(_initial(_q(spark, name)), ["o_orderpriority", "c_name"])
    assert order and order[0] == first, order
