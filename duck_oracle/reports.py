"""DuckDB SQL of the registered reports, written from their definitions.

Each report is stated over sets: who counts (``outsiders``), which organisation
answers to which external ids (``org_ids``), which events fall in the period.
Period arithmetic is done in SQL. Only parameter values are shared with the
library.
"""

from __future__ import annotations

from datetime import datetime, time

from duck_oracle.bindings import with_bindings
from pulseboard.params import BILLING_ID_LENGTH, CRM_ID_JSON_KEY
from pulseboard.plans.catalog import P


def ts(x) -> str:
    return f"TIMESTAMP '{x.isoformat()}'"


def one_of(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def without(ids) -> str:
    """Organisations kept by an exclusion list; an empty one keeps all."""
    return f"organization_id NOT IN ({', '.join(map(str, ids))})" if ids else "TRUE"


def outside(internal, org: str = "a.organization_id") -> str:
    """The event's user exists and is not an internal account."""
    free = f"{org} = {internal.exempt_org} OR " if internal.exempt_org is not None else ""
    return f"EXISTS (FROM users AS u WHERE u.user_id = a.user_id AND ({free}u.username NOT LIKE '{internal.pattern}'))"


def in_window(start, end) -> str:
    return f"created >= {ts(start)} AND created <= {ts(end)}"


def calendar(start, end) -> str:
    """One DATE a day, for points a whole number of days after the start."""
    return f"SELECT CAST(unnest(generate_series({ts(start)}, {ts(end)}, INTERVAL 1 DAY)) AS DATE) AS day"


#: Every organisation with each pair of profile rows it has, or one row without.
ORG_IDS = f"""
    SELECT o.organization_id, o.name AS org_name,
           CASE WHEN b.id IS NULL THEN left(c.billing_customer_id, {BILLING_ID_LENGTH}) ELSE b.id END AS bw_org_id,
           ifnull(b.customfields ->> '{CRM_ID_JSON_KEY}', c.id) AS hs_org_id
    FROM organization AS o
    LEFT JOIN crm_profile AS c ON c.id = o.crm_id
    LEFT JOIN billing_profile AS b ON b.id = o.billing_id"""
#: The same, each combination once, with the number of rows behind it.
WEIGHED_IDS = "SELECT organization_id, org_name, bw_org_id, hs_org_id, count(*) AS profiles FROM org_ids GROUP BY ALL"


def period(start, end) -> str:
    """One row: the bounds, the days between them, and where the previous period begins."""
    return f"""
    SELECT {ts(start)} AS s, {ts(end)} AS e,
           date_diff('day', {ts(start)}, {ts(end)}) AS n,
           CAST({ts(start)} AS DATE) - CAST(date_diff('day', {ts(start)}, {ts(end)}) - 1 AS INTEGER) AS early"""


# --------------------------------------------------------------------- R1
def r1(excluded=(), end=None) -> str:
    s, e = P.r1[0], end or P.r1[1]
    stems = P.targets.codes
    seen = f"""
    SELECT DISTINCT CAST(created AS DATE) AS day, organization_id, activity FROM user_activity AS a
    WHERE activity IN {one_of(stems.values())} AND {in_window(s, e)} AND {without(excluded)}
      AND organization_id IS NOT NULL AND {outside(P.internal)}"""
    sizes = "SELECT day, activity, count(*) AS orgs FROM seen GROUP BY ALL"
    totals = "SELECT day, count(DISTINCT organization_id) AS orgs FROM seen GROUP BY day"
    # a day with events of internal accounts only, or of no organisation, is a day without events
    columns = ", ".join(
        f"CASE WHEN t.orgs IS NOT NULL THEN ifnull((SELECT z.orgs FROM sizes AS z WHERE z.day = k.day AND z.activity = '{code}'), 0) END AS {stem}_orga_count"
        for stem, code in stems.items()
    )
    body = f"SELECT k.day, t.orgs AS total_orga_count, {columns} FROM days AS k LEFT JOIN totals AS t USING (day)"
    return with_bindings(body, days=calendar(s, e), seen=seen, sizes=sizes, totals=totals)


# --------------------------------------------------------------------- R2
def r2(bounds=None) -> str:
    begun = f"""
    SELECT CAST(valid_from AS DATE) AS day, count(DISTINCT organization_id) AS trials
    FROM org_subscription, p
    WHERE subscription_type_id = {P.trial.type_id} AND valid_from >= p.early AND valid_from <= p.e
    GROUP BY 1"""
    body = """
    SELECT d.day, ifnull(now.trials, 0) AS new_trials, d.before AS prev_day, ifnull(then_.trials, 0) AS prev_new_trials
    FROM (SELECT CAST(p.s AS DATE) + CAST(k AS INTEGER) AS day, CAST(p.s AS DATE) + CAST(k - p.n AS INTEGER) AS before
          FROM p, (SELECT unnest(generate_series(1, (SELECT n FROM p))) AS k)) AS d
    LEFT JOIN begun AS now ON now.day = d.day
    LEFT JOIN begun AS then_ ON then_.day = d.before"""
    return with_bindings(body, p=period(*(bounds or P.period)), begun=begun)


# --------------------------------------------------------------------- R3
def r3() -> str:
    seats = f"""
    SELECT DISTINCT organization_id, max_users, user_id
    FROM (FROM org_subscription WHERE subscription_type_id = {P.capped_type_id})
    JOIN (FROM user_license WHERE unassigned_at IS NULL) USING (org_subscription_id)"""
    present = f"""
    SELECT DISTINCT CAST(created AS DATE) AS created_date, organization_id, user_id FROM user_activity AS a
    WHERE activity IN {one_of(P.r3_activities)} AND {in_window(*P.window)} AND {outside(P.internal)}"""
    crowded = """
    SELECT created_date, organization_id, max_users, count(*) AS distinct_users
    FROM present JOIN seats USING (organization_id, user_id)
    GROUP BY ALL HAVING count(*) > max_users"""
    body = """
    SELECT organization_id AS org_id, org_name, max_users, distinct_users, created_date, bw_org_id, hs_org_id
    FROM crowded JOIN weighed USING (organization_id)"""
    return with_bindings(body, seats=seats, present=present, crowded=crowded, org_ids=ORG_IDS, weighed=WEIGHED_IDS)


# --------------------------------------------------------------------- R4
def r4() -> str:
    stems = P.targets.codes
    plans = """
    SELECT organization_id, count(*) AS plans FROM organization
    JOIN (FROM plan_variant WHERE coalesce(touchless, FALSE) AND NOT coalesce(enterprise, TRUE)) ON customer_id = billing_id
    GROUP BY organization_id"""
    use = f"""
    SELECT organization_id, {", ".join(f"sum(CAST(coalesce(activity = '{c}', FALSE) AS BIGINT)) AS {k}" for k, c in stems.items())},
           count(DISTINCT user_id) AS overall_uniq_users, max(created) AS last_activity
    FROM user_activity AS a SEMI JOIN plans USING (organization_id)
    WHERE {in_window(*P.window)} AND {outside(P.internal)}
    GROUP BY organization_id"""
    times = "use.{} * plans.plans * weighed.profiles"
    body = f"""
    SELECT organization_id AS org_id, org_name,
           {", ".join(f"CAST({times.format(k)} AS BIGINT) AS {k}_act" for k in stems)},
           CAST(({" + ".join(f"use.{k}" for k in stems)}) * plans.plans * weighed.profiles AS BIGINT) AS all_activities_count,
           overall_uniq_users, last_activity, hs_org_id, bw_org_id
    FROM use JOIN plans USING (organization_id) JOIN weighed USING (organization_id)"""
    return with_bindings(body, plans=plans, use=use, org_ids=ORG_IDS, weighed=WEIGHED_IDS)


# ---------------------------------------------------------------- R5, R17
def _slipping() -> dict[str, str]:
    c, now = P.cohort, ts(P.as_of)
    quiet = f"""
    SELECT organization_id, user_id FROM user_activity AS a
    WHERE activity IN {one_of(P.grabber_group)} AND created > {now} - INTERVAL {c.lookback_days} DAY
      AND user_id IN (SELECT user_id FROM users WHERE NOT is_deleted) AND {outside(P.internal)}
    GROUP BY ALL
    HAVING count(*) > {c.min_events} AND max(created) < {now} - INTERVAL {c.silent_days} DAY"""
    lost = "SELECT organization_id, count(DISTINCT user_id) AS user_count FROM quiet GROUP BY ALL"
    staff = "SELECT organization_id, count(DISTINCT user_id) AS total_user_count FROM users GROUP BY ALL"
    slipping = """
    SELECT organization_id AS org_id, org_name, user_count, total_user_count,
           (user_count::DOUBLE / total_user_count) * 100 AS slip_dist, bw_org_id, hs_org_id
    FROM lost JOIN staff USING (organization_id) JOIN weighed USING (organization_id)"""
    return {"quiet": quiet, "lost": lost, "staff": staff, "org_ids": ORG_IDS, "weighed": WEIGHED_IDS, "slipping": slipping}


def r5() -> str:
    return with_bindings("FROM slipping", **_slipping())


def r17() -> str:
    names = f"[{P.bands.medium}, {P.bands.high}]"
    body = f"SELECT *, ['low', 'medium', 'high'][1 + len(list_filter({names}, lambda b: slip_dist >= b))] AS severity FROM slipping"
    return with_bindings(body, **_slipping())


# --------------------------------------------------------------------- R6
def r6() -> str:
    given = """
    SELECT CAST(assigned_at AS DATE) AS day, name, count(*) AS seats
    FROM user_license JOIN org_subscription USING (org_subscription_id) JOIN subscription_type USING (subscription_type_id)
    GROUP BY ALL"""

    def family(f) -> str:
        return " OR ".join([f"starts_with(name, '{p}')" for p in f.prefixes] + [f"name = '{n}'" for n in f.names])

    columns = ", ".join(
        f"CAST(CASE WHEN count(given.day) > 0 THEN ifnull(sum(seats) FILTER (WHERE {family(f)}), 0) END AS BIGINT) AS {name}"
        for name, f in P.families.items()
    )
    every = "CAST(CASE WHEN count(given.day) > 0 THEN ifnull(sum(seats) FILTER (WHERE name IS NOT NULL), 0) END AS BIGINT)"
    body = f"SELECT days.day, {every} AS count_all, {columns} FROM days LEFT JOIN given USING (day) GROUP BY days.day"
    return with_bindings(body, days=calendar(*P.licence_window), given=given)


# --------------------------------------------------------------------- R7
def r7() -> str:
    tally = f"""
    SELECT activity, organization_id, count(*) AS events, max(created) AS last_act FROM user_activity AS a
    WHERE activity IN {one_of(P.errors)} AND {in_window(*P.window)} AND {outside(P.internal)}
    GROUP BY ALL"""
    body = """
    SELECT DISTINCT ON (activity) activity, organization_id AS org_id, events * profiles AS act_count, last_act, org_name, hs_org_id, bw_org_id
    FROM tally JOIN weighed USING (organization_id)
    ORDER BY activity, events * profiles DESC, organization_id, hs_org_id NULLS FIRST, bw_org_id NULLS FIRST"""
    return with_bindings(body, tally=tally, org_ids=ORG_IDS, weighed=WEIGHED_IDS)


# ------------------------------------------------------------- R8 .. R11
def _errors(activities, excluded=(), bounds=None) -> dict[str, str]:
    """Error events of both periods, of known users or of the exempt organisation, with all ids."""
    rule = P.internal
    kept = f"""
    SELECT a.*, u.user_id AS known_user, u.username
    FROM (FROM user_activity, p WHERE created >= p.early AND created <= p.e
            AND activity IN {one_of(activities)} AND {without(excluded)}) AS a
    LEFT JOIN users AS u ON u.user_id = a.user_id
    WHERE CASE WHEN a.organization_id = {rule.exempt_org} THEN TRUE ELSE u.username NOT LIKE '{rule.pattern}' END"""
    told = """
    SELECT CAST(k.created AS DATE) AS day, k.known_user AS user_id, k.username, i.organization_id AS org_id, i.org_name,
           k.activity, k.payload ->> 'k' AS meta, CAST(k.created > p.s AS INTEGER) AS interval_var,
           strftime(k.created, '%Y-%m-%d, %H:%M:%S UTC') AS date, i.hs_org_id, i.bw_org_id
    FROM p, kept AS k LEFT JOIN org_ids AS i USING (organization_id)"""
    return {"p": period(*(bounds or P.period)), "org_ids": ORG_IDS, "kept": kept, "told": told}


def r8(excluded=()) -> str:
    body = """
    FROM told
    UNION ALL BY NAME
    SELECT day, '' AS activity
    FROM (SELECT CAST(unnest(generate_series((SELECT early FROM p), (SELECT e FROM p), INTERVAL 1 DAY)) AS DATE) AS day)
    ANTI JOIN told USING (day)"""
    return with_bindings(body, **_errors(P.errors, excluded))


def r9(activities=None) -> str:
    body = "SELECT activity, sum(interval_var)::BIGINT AS error_count FROM told GROUP BY activity HAVING sum(interval_var) > 0"
    return with_bindings(body, **_errors(activities or P.errors))


def r10() -> str:
    return with_bindings("FROM told WHERE interval_var = 1", **_errors([P.error_type]))


def _per_day(error_type=None, bounds=None) -> dict[str, str]:
    """Events of one type a day: before the start those of the earlier period, from it on those after it."""
    ctes = _errors([error_type or P.error_type], (), bounds)
    ctes["per_day"] = """
    SELECT day, count(*) AS events FROM told, p
    WHERE (interval_var = 1) = (day >= CAST(p.s AS DATE)) GROUP BY day"""
    ctes["span"] = """
    SELECT CAST(p.s AS DATE) AS s, CAST(p.e AS DATE) AS e, p.early, d.day, per_day.events
    FROM p, (SELECT CAST(unnest(generate_series((SELECT early FROM p), (SELECT e FROM p), INTERVAL 1 DAY)) AS DATE) AS day) AS d
    LEFT JOIN per_day ON per_day.day = d.day"""
    return ctes


def r11(error_type=None, bounds=None) -> str:
    """Lists of days: the current one ends before ``end`` unless that day has events, the
    previous one starts after its first day unless that has events; paired place by place."""
    ctes = _per_day(error_type, bounds)
    pick = "SELECT list({{'day': day, 'events': ifnull(events, 0)}} ORDER BY day) AS days FROM span WHERE {}"
    ctes["ahead"] = pick.format("day > s AND (day < e OR events IS NOT NULL)")
    ctes["behind"] = pick.format("day <= s AND (day > early OR events IS NOT NULL OR early = s)")
    body = """
    SELECT ahead.days[k].day AS day, ahead.days[k].events AS error_count,
           behind.days[k].day AS prev_day, behind.days[k].events AS prev_error_count
    FROM ahead, behind, (SELECT unnest(generate_series(1, (SELECT len(days) FROM ahead))) AS k)"""
    return with_bindings(body, **ctes)


def r11_every_day() -> str:
    body = """
    SELECT x.day, ifnull(x.events, 0) AS error_count, y.day AS prev_day, ifnull(y.events, 0) AS prev_error_count
    FROM span AS x JOIN span AS y ON y.day = x.day - CAST(x.e - x.s AS INTEGER) WHERE x.day > x.s"""
    return with_bindings(body, **_per_day())


# ---------------------------------------------------------------- R12, R13
def _trial_days(label: str, value: str, name: str) -> str:
    s, e = P.window
    terms = f"""
    SELECT l.user_id, CAST(t.valid_from AS DATE) AS began
    FROM user_license AS l
    JOIN (FROM org_subscription WHERE subscription_type_id = {P.trial.type_id} AND valid_from > {ts(s)} AND valid_until > {ts(e)}) AS t
      USING (org_subscription_id)"""
    steps = f"""
    SELECT CAST(a.created AS DATE) - terms.began AS nr, {label} AS label, a.user_id
    FROM (FROM user_activity AS a WHERE activity IN {one_of(P.relevant)} AND {in_window(s, e)} AND {outside(P.internal_strict)}) AS a
    JOIN terms USING (user_id)
    WHERE CAST(a.created AS DATE) - terms.began < {P.trial.days}"""
    body = f"""
    SELECT CAST(nr + 1 AS INTEGER) AS day_nr, label AS {name}, CAST(max(amount) AS BIGINT) AS act_count
    FROM (SELECT nr, label, {value} AS amount FROM steps WHERE nr >= 0 GROUP BY ALL
          UNION ALL
          SELECT unnest(generate_series(0, {P.trial.days - 1})), label, 0 FROM (SELECT DISTINCT label FROM steps))
    GROUP BY ALL"""
    return with_bindings(body, terms=terms, steps=steps)


def r12() -> str:
    return _trial_days("split_part(a.activity, '_', 1)", "count(DISTINCT user_id)", "product_name")


def r13() -> str:
    return _trial_days("a.activity", "count(*)", "activity")


# ---------------------------------------------------------- R14 .. R16
def _of_trials(window, excluded) -> dict[str, str]:
    """Organisations by how often they were on trial, and their events outside the excluded activities."""
    unlisted = f"(activity IS NULL OR activity NOT IN {one_of(excluded)})" if excluded else "TRUE"
    return {
        "trial_orgs": f"""
    SELECT organization_id, count(*) AS trials FROM org_subscription
    SEMI JOIN (FROM subscription_type WHERE name = '{P.trial.type_name}') USING (subscription_type_id)
    GROUP BY organization_id""",
        "used": f"""
    SELECT organization_id, activity, split_part(activity, '_', 1) AS prefix, user_id, count(*) AS events FROM user_activity AS a
    WHERE {in_window(*window)} AND {unlisted} AND {outside(P.internal)}
    GROUP BY ALL""",
    }


def r14() -> str:
    listed = one_of(P.products.products)
    body = f"""
    SELECT product, CAST(sum(events) AS BIGINT) AS product_count
    FROM (SELECT CASE WHEN prefix IN {listed} THEN prefix ELSE '{P.products.other}' END AS product, events * trials AS events
          FROM used JOIN trial_orgs USING (organization_id) WHERE activity IS NOT NULL
          UNION ALL SELECT '{P.products.other}', 0)
    GROUP BY product"""
    return with_bindings(body, **_of_trials(P.window, P.excluded_activities))


def r15(excluded=None) -> str:
    body = """
    SELECT activity, CAST(sum(CASE WHEN activity IS NULL THEN 0 ELSE events * trials END) AS BIGINT) AS activity_count,
           count(DISTINCT user_id) AS user_count
    FROM used JOIN trial_orgs USING (organization_id) GROUP BY activity"""
    return with_bindings(body, **_of_trials(P.window, P.excluded_activities if excluded is None else excluded))


def r16(window=None) -> str:
    body = f"""
    SELECT product_mix, count(*) AS org_count
    FROM (SELECT organization_id, string_agg(DISTINCT prefix, '+' ORDER BY prefix) AS product_mix
          FROM used SEMI JOIN trial_orgs USING (organization_id)
          WHERE prefix IN {one_of(P.products.products)} GROUP BY organization_id)
    GROUP BY product_mix"""
    return with_bindings(body, **_of_trials(window or P.mix_window, P.excluded_activities))


# ------------------------------------------------- what the sinks store
LAST_MOMENT = datetime.combine(P.whole_days[1], time.max)


def window_of_orgs() -> str:
    codes = P.targets.codes
    counts = "".join(f", count(DISTINCT CASE WHEN activity = '{code}' THEN organization_id END) AS {stem}_orga_count" for stem, code in codes.items())
    body = f"""
    SELECT count(DISTINCT organization_id) AS total_orga_count{counts}
    FROM user_activity AS a
    WHERE {in_window(P.whole_days[0], LAST_MOMENT)} AND activity IN {one_of(codes.values())} AND {outside(P.internal)}"""
    return with_bindings(body)


def stored_rows() -> str:
    tables = {"user": "users"} | {t: t for t in (
        "organization", "org_subscription", "subscription_type", "user_license", "plan_variant", "billing_profile", "crm_profile")}
    others = "".join(f" UNION ALL SELECT '{name}', NULL, count(*), NULL FROM {table}" for name, table in tables.items())
    body = f"""
    SELECT 'user_activity' AS table_name, CAST(created AS DATE) AS day, count(*) AS n_rows, count(DISTINCT user_id) AS n_users
    FROM user_activity GROUP BY CAST(created AS DATE){others}"""
    return with_bindings(body)


def build() -> dict[str, str]:
    return {
        "daily_active_orgs_from_counts": r1(()),
        "daily_active_orgs_midday_end_from_counts": r1((), P.r1_midday_end),
        "most_active_touchless_orgs_from_counts": r4(),
        "slipping_away_orgs_from_counts": r5(),
        "top_org_per_error_from_counts": r7(),
        "active_orgs_whole_days": r1((), LAST_MOMENT),
        "active_orgs_of_window": window_of_orgs(),
        "warehouse_round_trip": stored_rows(),
        "daily_active_orgs": r1(()),
        "daily_active_orgs_excluded": r1(P.r1_excluded),
        "new_trials_vs_previous": r2(),
        "concurrent_license_exceeded": r3(),
        "most_active_touchless_orgs": r4(),
        "slipping_away_orgs": r5(),
        "daily_assigned_licenses": r6(),
        "top_org_per_error": r7(),
        "error_detail": r8(),
        "error_counts": r9(),
        "error_events": r10(),
        "error_daily_vs_previous": r11(),
        "trial_product_by_day": r12(),
        "trial_activity_by_day": r13(),
        "trial_activity_by_product": r14(),
        "trial_top_activities": r15(),
        "trial_product_mix": r16(),
        "slip_severity": r17(),
        "daily_active_orgs_midday_end": r1((), P.r1_midday_end),
        "new_trials_one_day": r2(P.one_day),
        "trial_top_activities_no_exclusions": r15(()),
        "error_detail_excluded": r8(P.r1_excluded),
        "error_daily_vs_previous_bcs": r11("BCS_ERROR"),
        "trial_product_mix_window": r16(P.window),
        "error_daily_vs_previous_first_day_empty": r11(None, P.r11_early),
        "error_daily_vs_previous_every_day": r11_every_day(),
        "error_counts_of_groups": r9(P.groups.codes("cards", "visits")),
    }


__all__ = ["build"]
