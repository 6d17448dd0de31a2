"""Rolled-up and weighted forms give the numbers of the joins they replace.

Fan-outs (several trial subscriptions, plans, profiles of one organisation) are
set up on small inline frames with results counted by hand; a property test
compares the roll-up with a join event by event.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pulseboard.functions.predicates import keep_external
from pulseboard.functions.time import day_of
from pulseboard.operators.counts import distinct_count_by
from pulseboard.operators.rollup import rollup_activity, with_user_rule
from pulseboard.params import Cohort, InternalRule, ProductSpec, Targets, TrialSpec
from pulseboard.plans import (
    most_active_touchless_orgs,
    slipping_away_orgs,
    trial_activity_by_product,
    trial_top_activities,
)
from tests.conftest import rows, ts

NOBODY = InternalRule(pattern="%@corp")


def _events(*items):
    return [(k, user, org, code, ts(at), None) for k, (user, org, code, at) in enumerate(items)]


def test_events_count_once_per_trial_of_their_organisation(dom):
    """Organisation 5 was on trial three times (two subscriptions, one of them of
    a type listed twice), organisation 6 once, organisation 7 never."""
    d = dom.make(
        user_activity=_events(
            (1, 5, "BCS_A", "2024-01-02 08:00:00"), (1, 5, "BCS_A", "2024-01-02 09:00:00"),
            (2, 5, "XX_B", "2024-01-03 08:00:00"), (3, 6, "BCS_A", "2024-01-02 08:00:00"),
            (4, 7, "BCS_A", "2024-01-02 08:00:00"), (2, 5, None, "2024-01-02 08:00:00"),
        ),
        user=[(k, f"u{k}", 5, False) for k in (1, 2, 3, 4)],
        organization=[(o, f"o{o}", None, None) for o in (5, 6, 7)],
        org_subscription=[
            (50, 5, 1, 1, ts("2023-01-01"), ts("2023-02-01")), (51, 5, 2, 1, ts("2023-01-01"), ts("2023-02-01")),
            (60, 6, 1, 1, ts("2023-01-01"), ts("2023-02-01")), (70, 7, 3, 1, ts("2023-01-01"), ts("2023-02-01")),
        ],
        subscription_type=[(1, "T"), (2, "T"), (2, "T"), (3, "PAID")],
    )
    trial = TrialSpec(type_id=1, type_name="T")
    window = ("2024-01-01", "2024-01-31")
    top = rows(trial_top_activities(d, *window, internal=NOBODY, trial=trial))
    assert sorted(top, key=str) == sorted([("BCS_A", 2 * 3 + 1, 2), ("XX_B", 3, 1), (None, 0, 1)], key=str)
    spec = ProductSpec(products=("BCS",), other="OTHER")
    per = rows(trial_activity_by_product(d, *window, internal=NOBODY, trial=trial, products=spec))
    assert sorted(per) == [("BCS", 7), ("OTHER", 3)]


def test_plans_and_profiles_multiply_counts_but_not_users(dom):
    """Two matching plan rows and two CRM profiles with one id make four rows an event."""
    d = dom.make(
        user_activity=_events(
            (1, 5, "CS", "2024-01-02 08:00:00"), (1, 5, "VR", "2024-01-02 09:00:00"), (2, 5, "VR", "2024-01-04 09:00:00"),
            (3, 6, "CS", "2024-01-02 08:00:00"), (4, 8, "CS", "2024-01-02 08:00:00"),
        ),
        user=[(k, f"u{k}", 5, False) for k in (1, 2, 3, 4)],
        organization=[(5, "five", "b5", "c5"), (6, "six", "b6", None), (8, "eight", "b8", None)],
        plan_variant=[("b5", True, False), ("b5", True, False), ("b5", True, None), ("b6", None, False), ("b8", True, True)],
        crm_profile=[("c5", "ref"), ("c5", "ref")],
    )
    got = rows(
        most_active_touchless_orgs(d, "2024-01-01", "2024-01-31", internal=NOBODY, targets=Targets({"cs": "CS", "vr": "VR", "dq": "DQ"})),
        "org_id", "cs_act", "vr_act", "dq_act", "all_activities_count", "overall_uniq_users", "last_activity",
    )
    assert got == [(5, 4, 8, 0, 12, 2, ts("2024-01-04 09:00:00"))]


def test_cohort_and_members_are_counted_apart(dom):
    """Two of the three members of organisation 5 went quiet; one of them is also in organisation 6."""
    old = "2024-01-02 08:00:00"
    d = dom.make(
        user_activity=_events(*[(u, o, "G", old) for u, o in ((1, 5), (1, 5), (2, 5), (2, 5), (1, 6), (1, 6), (3, 5))]),
        user=[(1, "a", 5, False), (2, "b", 5, False), (3, "c", 5, False), (4, "d", 6, False)],
        organization=[(5, "five", None, None), (6, "six", None, None)],
    )
    got = rows(
        slipping_away_orgs(d, "2024-01-20", ["G"], internal=NOBODY, cohort=Cohort(lookback_days=30, silent_days=3, min_events=1)),
        "org_id", "user_count", "total_user_count",
    )
    assert sorted(got) == [(5, 2, 3), (6, 1, 1)]


# --------------------------------------------------------------- property
RULE = InternalRule(pattern="%x", exempt_org=1)
BASE = datetime(2024, 1, 1)
events = st.lists(
    st.tuples(
        st.integers(0, 5),  # user
        st.one_of(st.none(), st.integers(0, 3)),  # organisation
        st.sampled_from(["A_1", "B_2", "C_3", None]),  # activity
        st.integers(0, 4),  # day
        st.integers(0, 86399),  # second of the day
    ),
    min_size=0,
    max_size=40,
)
names = st.lists(st.sampled_from(["ux", "uy", None]), min_size=6, max_size=6)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(evts=events, usernames=names)
def test_rollup_and_two_level_counts_equal_naive(spark, evts, usernames):
    act = spark.createDataFrame(
        [(u, o, a, BASE + timedelta(days=dd, seconds=sec)) for u, o, a, dd, sec in evts],
        "user_id BIGINT, organization_id BIGINT, activity STRING, created TIMESTAMP_NTZ",
    )
    users = spark.createDataFrame(
        [(i, n) for i, n in enumerate(usernames) if i != 5],  # user 5 has no user row
        "user_id BIGINT, username STRING",
    )
    # naive: join every event, filter, count distinct with FILTER
    naive = (
        act.join(users, "user_id")
        .filter(keep_external("organization_id", "username", RULE))
        .groupBy(day_of("created").alias("day"))
        .agg(
            F.count_distinct("organization_id").alias("total"),
            F.count_distinct(F.when(F.col("activity") == "A_1", F.col("organization_id"))).alias("a"),
        )
    )
    rolled = rollup_activity(act, [day_of("created").alias("day")], [F.max(F.col("activity") == "A_1").alias("has_a")])
    kept = with_user_rule(rolled, users, RULE)
    ours = distinct_count_by(kept, ["day"], "organization_id", {"total": None, "a": F.col("has_a")})
    assert sorted(rows(naive)) == sorted(rows(ours))
