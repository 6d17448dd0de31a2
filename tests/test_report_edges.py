"""Edge rules of SURVEY section 2.2 on inline fixtures (FIXTURES section 3),
checked against hand-computed rows."""

from __future__ import annotations

from datetime import date

import pytest

from pulseboard.functions.ids import org_external_ids
from pulseboard.params import CRM_ID_JSON_KEY as KEY
from pulseboard.params import Bands, Cohort, InternalRule, TrialSpec
from pulseboard.plans import (
    concurrent_license_exceeded,
    daily_active_orgs,
    daily_assigned_licenses,
    error_counts,
    error_daily_vs_previous,
    error_detail,
    error_events,
    most_active_touchless_orgs,
    new_trials_vs_previous,
    slip_severity,
    slipping_away_orgs,
    top_org_per_error,
    trial_activity_by_day,
    trial_activity_by_product,
    trial_product_by_day,
    trial_product_mix,
    trial_top_activities,
)
from tests.conftest import rows, ts

RULE = InternalRule(pattern="%@corp", exempt_org=1)
D = date.fromisoformat


def act(i, user, org, activity, created, payload=None):
    return (i, user, org, activity, ts(created), payload)


def usr(uid, name, org, deleted=False):
    return (uid, name, org, deleted)


# ---------------------------------------------------------------- R1 / R6
def test_r1_last_day_only_midnight_and_null_days(dom):
    d = dom.make(
        user_activity=[
            act(1, 10, 2, "BCS_CARDS_SCAN_PROCESS", "2024-01-03 00:00:00"),
            act(2, 11, 3, "BCS_CARDS_SCAN_PROCESS", "2024-01-03 00:00:01"),
            act(3, 10, 2, "VR_REPORT_START", "2024-01-01 10:00:00"),
            act(4, 11, 3, "VR_REPORT_START", "2024-01-01 11:00:00"),
            act(5, 12, 4, "VR_REPORT_START", "2024-01-01 12:00:00"),  # internal user
            act(6, 13, 1, "VR_REPORT_START", "2024-01-01 12:00:00"),  # internal, exempt org
        ],
        user=[usr(10, "a@x", 2), usr(11, "b@x", 3), usr(12, "c@corp", 4), usr(13, "d@corp", 1)],
    )
    out = rows(daily_active_orgs(d, "2024-01-01", "2024-01-03", internal=RULE))
    assert out == [
        (D("2024-01-01"), 3, 0, 3, 0),
        (D("2024-01-02"), None, None, None, None),
        (D("2024-01-03"), 1, 1, 0, 0),
    ]
    excl = rows(daily_active_orgs(d, "2024-01-01", "2024-01-03", [2, 1], internal=RULE))
    assert excl[0] == (D("2024-01-01"), 1, 0, 1, 0)


def test_r1_spine_off_midnight_matches_nothing(dom):
    d = dom.make(
        user_activity=[act(1, 10, 2, "VR_REPORT_START", "2024-01-02 10:00:00")],
        user=[usr(10, "a@x", 2)],
    )
    out = rows(daily_active_orgs(d, "2024-01-01T06:00:00", "2024-01-03", internal=RULE))
    assert [r[0] for r in out] == [D("2024-01-01"), D("2024-01-02")]
    assert all(r[1] is None for r in out)


def test_r6_whole_last_day_and_families(dom):
    d = dom.make(
        user_license=[
            (1, 100, ts("2024-01-03 00:00:00"), None),
            (2, 100, ts("2024-01-03 23:59:59"), None),
            (3, 101, ts("2024-01-01 08:00:00"), None),  # name NULL: not counted
            (4, 102, ts("2024-01-01 08:00:00"), None),  # name in no family: total only
            (5, 999, ts("2024-01-01 08:00:00"), None),  # no subscription: dropped
            (6, 103, ts("2024-01-04 08:00:00"), None),  # after the range
        ],
        org_subscription=[
            (100, 1, 7, 1, ts("2024-01-01"), ts("2024-12-01")),
            (101, 1, 8, 1, ts("2024-01-01"), ts("2024-12-01")),
            (102, 1, 9, 1, ts("2024-01-01"), ts("2024-12-01")),
            (103, 1, 7, 1, ts("2024-01-01"), ts("2024-12-01")),
        ],
        subscription_type=[(7, "VISIT_REPORT"), (8, None), (9, "SOMETHING")],
    )
    out = rows(daily_assigned_licenses(d, "2024-01-01", "2024-01-03"))
    assert out == [
        (D("2024-01-01"), 1, 0, 0, 0, 0),
        (D("2024-01-02"), None, None, None, None, None),
        (D("2024-01-03"), 2, 2, 0, 0, 0),
    ]


# --------------------------------------------------------------------- R2
def _trial_subs(days):
    return [
        (i, 10 + i, 16, 1, ts(f"{day} 00:00:00"), ts("2025-01-01 00:00:00")) for i, day in enumerate(days)
    ]


def test_r2_equal_bounds_is_empty(dom):
    d = dom.make(org_subscription=_trial_subs(["2024-01-05"]))
    assert new_trials_vs_previous(d, "2024-01-05", "2024-01-05").count() == 0


@pytest.mark.parametrize("n", [1, 2, 7])
def test_r2_pairs_with_n_days_earlier(dom, n):
    start = D("2024-01-10")
    end = date.fromordinal(start.toordinal() + n)
    prev_day = date.fromordinal(start.toordinal() - n + 1)
    d = dom.make(org_subscription=_trial_subs([prev_day.isoformat(), end.isoformat()]))
    out = rows(new_trials_vs_previous(d, start, end))
    assert len(out) == n
    for day, cnt, pday, pcnt in out:
        assert (day - pday).days == n
    assert out[0][2] == prev_day and out[0][3] == 1
    assert out[-1][0] == end and out[-1][1] == 1
    assert sum(r[1] for r in out) == 1 and sum(r[3] for r in out) == 1


# ------------------------------------------------------------- R8 .. R11
ERRS = ["VR_ERROR", "BCS_ERROR"]


def _error_domain(dom):
    return dom.make(
        user_activity=[
            act(1, 10, 2, "VR_ERROR", "2024-01-10 00:00:00", '{"meta": "m1"}'),  # exactly at start
            act(2, 10, 2, "VR_ERROR", "2024-01-10 00:00:00.000001", '{"meta": 5}'),
            act(3, 10, 2, "VR_ERROR", "2024-01-12 09:00:00", "{}"),
            act(4, 10, 2, "BCS_ERROR", "2024-01-09 09:00:00", '{"meta": null}'),
            act(5, 99, 1, "VR_ERROR", "2024-01-11 09:00:00"),  # no user, exempt org
            act(6, 98, 3, "VR_ERROR", "2024-01-11 09:00:00"),  # no user, other org: dropped
        ],
        user=[usr(10, "a@x", 2)],
        organization=[(2, "Org2", "bw-2", None)],
    )


def test_r8_flags_blank_days_and_meta(dom):
    # start 01-10, end 01-13: N = 3, series 01-08 .. 01-13
    d = _error_domain(dom)
    out = error_detail(d, "2024-01-10", "2024-01-13", ERRS, internal=RULE)
    got = rows(out, "day", "activity", "interval_var", "meta", "user_id", "org_id")
    assert got == [
        (D("2024-01-08"), "", None, None, None, None),
        (D("2024-01-09"), "BCS_ERROR", 0, None, 10, 2),
        (D("2024-01-10"), "VR_ERROR", 0, "m1", 10, 2),
        (D("2024-01-10"), "VR_ERROR", 1, "5", 10, 2),
        (D("2024-01-11"), "VR_ERROR", 1, None, None, None),
        (D("2024-01-12"), "VR_ERROR", 1, None, 10, 2),
        (D("2024-01-13"), "", None, None, None, None),
    ]
    first = out.filter("interval_var IS NOT NULL").select("date").first()[0]
    assert first == "2024-01-09, 09:00:00 UTC"


def test_r9_r10_r11(dom):
    d = _error_domain(dom)
    args = ("2024-01-10", "2024-01-13")
    assert rows(error_counts(d, *args, ERRS, internal=RULE)) == [("VR_ERROR", 3)]
    ev = error_events(d, *args, ERRS, "VR_ERROR", internal=RULE)
    assert ev.count() == 3
    daily = rows(error_daily_vs_previous(d, *args, ERRS, "VR_ERROR", internal=RULE))
    # without events 01-13 (the end) and 01-08 (the first previous day) are left
    # out, so the previous series moves up by one; day 01-10 holds only its
    # after-midnight event
    assert daily == [
        (D("2024-01-11"), 1, D("2024-01-09"), 0),
        (D("2024-01-12"), 1, D("2024-01-10"), 1),
    ]
    every = rows(error_daily_vs_previous(d, *args, ERRS, "VR_ERROR", internal=RULE, every_day=True))
    assert every == [
        (D("2024-01-11"), 1, D("2024-01-08"), 0),
        (D("2024-01-12"), 1, D("2024-01-09"), 0),
        (D("2024-01-13"), 0, D("2024-01-10"), 1),
    ]


def test_r7_tie_goes_to_smaller_org(dom):
    d = dom.make(
        user_activity=[
            act(1, 10, 5, "VR_ERROR", "2024-01-10 01:00:00"),
            act(2, 11, 3, "VR_ERROR", "2024-01-10 02:00:00"),
            act(3, 11, 3, "BCS_ERROR", "2024-01-10 02:00:00"),
            act(4, 10, 5, "BCS_ERROR", "2024-01-10 03:00:00"),
            act(5, 10, 5, "BCS_ERROR", "2024-01-10 04:00:00"),
        ],
        user=[usr(10, "a@x", 5), usr(11, "b@x", 3)],
        organization=[(3, "O3", None, None), (5, "O5", None, None)],
    )
    out = rows(top_org_per_error(d, "2024-01-01", "2024-01-31", ERRS, internal=RULE), "activity", "org_id", "act_count")
    assert out == [("BCS_ERROR", 5, 2), ("VR_ERROR", 3, 1)]


# --------------------------------------------------------------------- R3
def test_r3_strict_cap_and_null_cap(dom):
    day = "2024-01-10 10:00:00"
    d = dom.make(
        user_activity=[act(i, u, 1, "VR_REPORT_START", day) for i, u in enumerate([10, 11, 12, 20, 21])],
        user=[usr(u, f"u{u}@x", 1) for u in (10, 11, 12, 20, 21)],
        organization=[(1, "O1", None, None)],
        org_subscription=[
            (100, 1, 32, 2, ts("2024-01-01"), ts("2024-12-01")),  # 3 users > 2: kept
            (101, 1, 32, None, ts("2024-01-01"), ts("2024-12-01")),  # NULL cap: dropped
            (102, 1, 32, 2, ts("2024-01-01"), ts("2024-12-01")),  # same cap merges with 100
        ],
        user_license=[
            (10, 100, ts("2024-01-01"), None),
            (11, 100, ts("2024-01-01"), None),
            (12, 102, ts("2024-01-01"), None),
            (20, 101, ts("2024-01-01"), None),
            (21, 100, ts("2024-01-01"), ts("2024-01-05")),  # unassigned: not counted
        ],
    )
    out = rows(concurrent_license_exceeded(d, "2024-01-10", "2024-01-11", internal=RULE),
               "org_id", "max_users", "distinct_users", "created_date")
    assert out == [(1, 2, 3, D("2024-01-10"))]


# --------------------------------------------------------------------- R4
def test_r4_plan_variants_multiply_counts_not_users(dom):
    d = dom.make(
        user_activity=[
            act(1, 10, 1, "VR_REPORT_START", "2024-01-10 01:00:00"),
            act(2, 11, 1, "LOGIN_VIEW", "2024-01-10 02:00:00"),
            act(3, 12, 2, "VR_REPORT_START", "2024-01-10 01:00:00"),
        ],
        user=[usr(10, "a@x", 1), usr(11, "b@x", 1), usr(12, "c@x", 2)],
        organization=[(1, "O1", "bw-1", None), (2, "O2", "bw-2", None)],
        plan_variant=[("bw-1", True, False), ("bw-1", True, False), ("bw-2", None, False)],
    )
    out = rows(most_active_touchless_orgs(d, "2024-01-01", "2024-01-31", internal=RULE),
               "org_id", "vr_act", "all_activities_count", "overall_uniq_users")
    assert out == [(1, 2, 2, 2)]


# --------------------------------------------------------------- R5, R17
def test_r5_cohort_thresholds_deleted_and_sort(dom):
    as_of = "2024-03-01"
    cohort = Cohort(lookback_days=120, silent_days=30, min_events=3)
    ev = []
    i = 0

    def burst(user, org, n, last):
        nonlocal i
        for k in range(n):
            i += 1
            ev.append(act(i, user, org, "GRABBER_EXPORT_CRM", last if k == n - 1 else "2024-01-05 10:00:00"))

    burst(10, 1, 4, "2024-01-30 23:59:59")  # 4 > 3, silent: in
    burst(11, 1, 3, "2024-01-20 00:00:00")  # exactly 3: out
    burst(12, 1, 4, "2024-01-31 00:00:00")  # last exactly at the limit: out
    burst(13, 1, 4, "2024-01-15 00:00:00")  # deleted: out of cohort, still in total
    burst(20, 2, 4, "2024-01-15 00:00:00")  # org with NULL name
    d = dom.make(
        user_activity=ev,
        user=[usr(10, "a@x", 1), usr(11, "b@x", 1), usr(12, "c@x", 1), usr(13, "d@x", 1, True),
              usr(20, "e@x", 2), usr(21, "f@x", 2)],
        organization=[(1, "Org1", None, None), (2, None, None, None)],
    )
    out = slipping_away_orgs(d, as_of, ["GRABBER_EXPORT_CRM"], internal=RULE, cohort=cohort)
    got = rows(out, "org_id", "user_count", "total_user_count", "slip_dist")
    assert got == [(2, 1, 2, 50.0), (1, 1, 4, 25.0)]
    sev = rows(slip_severity(out, Bands(high=50.0, medium=25.0)), "org_id", "severity")
    assert sev == [(2, "high"), (1, "medium")]


def test_r5_null_org_name_sorts_last(dom):
    cohort = Cohort(lookback_days=120, silent_days=30, min_events=0)
    d = dom.make(
        user_activity=[act(1, 10, 1, "G", "2024-01-05 00:00:00"), act(2, 20, 2, "G", "2024-01-05 00:00:00")],
        user=[usr(10, "a@x", 1), usr(20, "b@x", 2)],
        organization=[(1, None, None, None), (2, "B", None, None)],
    )
    got = rows(slipping_away_orgs(d, "2024-03-01", ["G"], internal=RULE, cohort=cohort), "org_id")
    assert got == [(2,), (1,)]


# ----------------------------------------------------------------- ids
def test_external_ids_all_combinations(dom):
    d = dom.make(
        organization=[
            (1, "billing only", "bw-1", None),
            (2, "crm only", None, "hs-2"),
            (3, "both", "bw-3", "hs-3"),
            (4, "neither", None, None),
            (5, "json missing", "bw-5", None),
            (6, "json null", "bw-6", "hs-6"),
            (7, "json numeric", "bw-7", None),
        ],
        billing_profile=[
            ("bw-1", f'{{"{KEY}": "h1"}}'),
            ("bw-3", f'{{"{KEY}": "h3"}}'),
            ("bw-5", "{}"),
            ("bw-6", f'{{"{KEY}": null}}'),
            ("bw-7", f'{{"{KEY}": 77}}'),
        ],
        crm_profile=[
            ("hs-2", "a-very-long-billing-reference-xyz"),
            ("hs-3", "other"),
            ("hs-6", "short"),
        ],
    )
    ext = org_external_ids(d.organization, d.billing_profile, d.crm_profile)
    got = sorted(rows(ext, "organization_id", "bw_org_id", "hs_org_id"))
    assert got == [
        (1, "bw-1", "h1"),
        (2, "a-very-long-billing-refe", "hs-2"),
        (3, "bw-3", "h3"),
        (4, None, None),
        (5, "bw-5", None),
        (6, "bw-6", "hs-6"),
        (7, "bw-7", "77"),
    ]


# ---------------------------------------------------------------- R12, R13
TRIAL = TrialSpec(type_id=16, type_name="FREE_TRIAL", days=14)
STRICT = InternalRule(pattern="%corp%", exempt_org=None)


def test_r12_r13_trial_days_and_multiplicity(dom):
    # trial starts 2024-01-05; window 2024-01-01 .. 2024-01-31
    events = [
        act(1, 10, 1, "BCS_SCAN", "2024-01-04 10:00:00"),  # day -1: listed, all zero
        act(2, 10, 1, "VR_START", "2024-01-05 10:00:00"),  # day 0 -> 1
        act(3, 10, 1, "VR_START", "2024-01-05 11:00:00"),
        act(4, 10, 1, "VR_START", "2024-01-18 10:00:00"),  # day 13 -> 14
        act(5, 10, 1, "EXPORT_X", "2024-01-19 10:00:00"),  # day 14: dropped, not listed
    ]
    d = dom.make(
        user_activity=events,
        user=[usr(10, "a@x", 1)],
        org_subscription=[
            (100, 1, 16, 1, ts("2024-01-05 08:00:00"), ts("2024-03-01")),
            (101, 1, 16, 1, ts("2024-01-05 09:00:00"), ts("2024-03-01")),  # second licence, same day
        ],
        user_license=[(10, 100, None, None), (10, 101, None, None)],
    )
    rel = ["BCS_SCAN", "VR_START", "EXPORT_X"]
    r12 = rows(trial_product_by_day(d, "2024-01-01", "2024-01-31", rel, internal=STRICT, trial=TRIAL))
    assert len(r12) == 28
    assert {r[1] for r in r12} == {"BCS", "VR"}
    vr = {r[0]: r[2] for r in r12 if r[1] == "VR"}
    assert vr[1] == 1 and vr[14] == 1 and sum(vr.values()) == 2
    assert all(r[2] == 0 for r in r12 if r[1] == "BCS")
    r13 = rows(trial_activity_by_day(d, "2024-01-01", "2024-01-31", rel, internal=STRICT, trial=TRIAL))
    vr13 = {r[0]: r[2] for r in r13 if r[1] == "VR_START"}
    assert vr13[1] == 4 and vr13[14] == 2  # two events x two licences; one event x two


# ---------------------------------------------------------- R14 .. R16
def _trial_org_domain(dom, events, users):
    return dom.make(
        user_activity=events,
        user=users,
        organization=[(1, "O1", None, None), (2, "O2", None, None)],
        org_subscription=[
            (100, 1, 16, 1, ts("2023-01-01"), ts("2023-02-01")),
            (101, 1, 16, 1, ts("2023-06-01"), ts("2023-07-01")),  # two trial rows: counts x2
            (102, 2, 16, 1, ts("2023-06-01"), ts("2023-07-01")),
        ],
        subscription_type=[(16, "FREE_TRIAL")],
    )


def test_r14_r15_r16(dom):
    events = [
        act(1, 10, 1, "BCS_SCAN", "2024-01-10 10:00:00"),
        act(2, 10, 1, None, "2024-01-10 10:00:00"),
        act(3, 10, 1, "VR_START", "2024-01-10 11:00:00"),
        act(4, 20, 2, "LOGIN_VIEW", "2024-01-10 11:00:00"),
        act(5, 10, 1, "BCS_CLICK", "2024-01-10 11:00:00"),  # excluded activity
    ]
    d = _trial_org_domain(dom, events, [usr(10, "a@x", 1), usr(20, "b@x", 2)])
    win = ("2024-01-01", "2024-01-31")
    r14 = rows(trial_activity_by_product(d, *win, ["BCS_CLICK"], internal=RULE, trial=TRIAL))
    assert r14 == [("OTHER", 1), ("BCS", 2), ("VR", 2)]
    r15 = rows(trial_top_activities(d, *win, ["BCS_CLICK"], internal=RULE, trial=TRIAL))
    assert r15 == [("BCS_SCAN", 2, 1), ("VR_START", 2, 1), ("LOGIN_VIEW", 1, 1), (None, 0, 1)]
    assert sum(r[1] for r in r14) == sum(r[1] for r in r15)
    r16 = rows(trial_product_mix(d, *win, ["BCS_CLICK"], internal=RULE, trial=TRIAL))
    assert r16 == [("BCS+VR", 1)]  # org 2 has only an unlisted product


def test_r14_other_row_always_and_r16_empty(dom):
    events = [act(1, 10, 1, "BCS_SCAN", "2024-01-10 10:00:00")]
    d = _trial_org_domain(dom, events, [usr(10, "a@x", 1)])
    r14 = rows(trial_activity_by_product(d, "2024-01-01", "2024-01-31", [], internal=RULE, trial=TRIAL))
    assert r14 == [("OTHER", 0), ("BCS", 2)]
    empty = trial_product_mix(d, "2023-01-01", "2023-01-31", [], internal=RULE, trial=TRIAL)
    assert empty.count() == 0
