"""DuckDB twins of the single-operator runs."""

from __future__ import annotations

from duck_oracle.bindings import with_bindings
from duck_oracle.reports import ORG_IDS, one_of, period, ts
from pulseboard.plans.catalog import EVENT_TYPES, P
from pulseboard.plans.single_ops import (
    EXCLUDED_ORGS,
    HEAVY_MIN_EVENTS,
    PAIR_PERIOD,
    SHARE_BANDS,
    SPINE_DAYS,
)


def calendar_spine_events() -> str:
    s, e = SPINE_DAYS
    body = f"""
    SELECT CAST(cal.day AS DATE) AS day, q.n_events
    FROM generate_series({ts(s)}, {ts(e)}, INTERVAL 1 DAY) AS cal(day)
    LEFT JOIN (SELECT date_trunc('day', created) AS d, count(*) AS n_events
               FROM user_activity GROUP BY 1) AS q ON q.d = cal.day"""
    return with_bindings(body)


def exclusion_list_counts() -> str:
    excl = ", ".join(str(x) for x in EXCLUDED_ORGS)
    return with_bindings(
        f"SELECT organization_id, count(*) AS n_events FROM user_activity "
        f"WHERE organization_id NOT IN ({excl}) GROUP BY organization_id"
    )


def exclusion_empty_list_counts() -> str:
    return with_bindings(
        "SELECT organization_id, count(*) AS n_events FROM user_activity GROUP BY organization_id"
    )


def not_exists_activity_counts() -> str:
    return with_bindings(
        "SELECT activity, count(*) AS n_events FROM user_activity "
        f"WHERE activity IS NULL OR activity NOT IN {one_of(P.excluded_activities)} GROUP BY activity"
    )


def json_text_values() -> str:
    return with_bindings(
        "SELECT payload ->> 'k' AS meta, count(*) AS n_events FROM user_activity GROUP BY 1"
    )


def external_ids() -> str:
    return with_bindings("SELECT organization_id, org_name, bw_org_id, hs_org_id FROM ids", ids=ORG_IDS)


def heavy_users_having() -> str:
    return with_bindings(f"""
    SELECT user_id, organization_id, count(*) AS n_events, max(created) AS last_at
    FROM user_activity GROUP BY user_id, organization_id HAVING count(*) > {HEAVY_MIN_EVENTS}""")


def daily_conditional_distinct() -> str:
    return with_bindings("""
    SELECT CAST(created AS DATE) AS day,
           count(DISTINCT organization_id) AS orgs,
           count(DISTINCT organization_id) FILTER (WHERE activity LIKE '%\\_ERROR' ESCAPE '\\') AS orgs_error,
           count(DISTINCT organization_id) FILTER (WHERE activity LIKE '%\\_PURCHASE' ESCAPE '\\') AS orgs_purchase
    FROM user_activity GROUP BY 1""")


def org_filtered_counts() -> str:
    parts = [
        f"count(*) FILTER (WHERE suffix(activity, '_{t}')) AS n_{t.lower()}" for t in EVENT_TYPES
    ]
    total = " + ".join(f"count(*) FILTER (WHERE suffix(activity, '_{t}'))" for t in EVENT_TYPES)
    return with_bindings(
        f"SELECT organization_id, {', '.join(parts)}, CAST({total} AS BIGINT) AS n_typed "
        f"FROM user_activity GROUP BY organization_id"
    )


def top_org_per_activity() -> str:
    return with_bindings("""
    SELECT activity, organization_id, n_events FROM (
        SELECT activity, organization_id, count(*) AS n_events,
               row_number() OVER (PARTITION BY activity ORDER BY count(*) DESC, organization_id ASC NULLS FIRST) AS rk
        FROM user_activity GROUP BY activity, organization_id) AS t
    WHERE rk = 1""")


def daily_pairing() -> str:
    per_day = "SELECT CAST(created AS DATE) AS day, count(*) AS n_events FROM user_activity GROUP BY 1"
    body = """
    SELECT d.day, ifnull(x.n_events, 0) AS n_events, d.before AS prev_day, ifnull(y.n_events, 0) AS prev_n_events
    FROM (SELECT CAST(p.s AS DATE) + CAST(k AS INTEGER) AS day, CAST(p.s AS DATE) + CAST(k - p.n AS INTEGER) AS before
          FROM p, (SELECT unnest(generate_series(1, (SELECT n FROM p))) AS k)) AS d
    LEFT JOIN per_day AS x ON x.day = d.day
    LEFT JOIN per_day AS y ON y.day = d.before"""
    return with_bindings(body, p=period(*PAIR_PERIOD), per_day=per_day)


def product_fold_other() -> str:
    listed = one_of(P.products.products)
    return with_bindings(f"""
    SELECT CASE WHEN split_part(activity, '_', 1) IN {listed} THEN split_part(activity, '_', 1)
                ELSE '{P.products.other}' END AS product,
           count(*) AS n_events
    FROM user_activity GROUP BY 1""")


def org_error_share_band() -> str:
    high, medium = SHARE_BANDS
    return with_bindings(f"""
    SELECT organization_id, error_share,
           CASE WHEN error_share >= {high} THEN 'high' WHEN error_share >= {medium} THEN 'medium'
                WHEN error_share < {medium} THEN 'low' END AS severity
    FROM (SELECT organization_id,
                 CAST(count(*) FILTER (WHERE suffix(activity, '_ERROR')) AS DOUBLE) / count(*) * 100 AS error_share
          FROM user_activity GROUP BY organization_id) AS t""")


def days_since_first_event() -> str:
    return with_bindings("""
    SELECT CAST(date_diff('day', f.first_day, CAST(a.created AS DATE)) AS INTEGER) AS day_nr, count(*) AS n_events
    FROM user_activity AS a
        JOIN (SELECT user_id, min(CAST(created AS DATE)) AS first_day FROM user_activity GROUP BY user_id) AS f
          ON a.user_id = f.user_id
    GROUP BY 1""")


def licence_family_counts() -> str:
    def cond(f):
        terms = [f"ty.name LIKE '{p}%'" for p in f.prefixes] + [f"ty.name = '{n}'" for n in f.names]
        return " OR ".join(terms)

    fams = ", ".join(f"count(ty.name) FILTER (WHERE {cond(f)}) AS {col}" for col, f in P.families.items())
    return with_bindings(f"""
    SELECT count(ty.name) AS count_all, {fams}
    FROM user_license AS lc
        LEFT JOIN org_subscription AS sb ON lc.org_subscription_id = sb.org_subscription_id
        JOIN subscription_type AS ty ON sb.subscription_type_id = ty.subscription_type_id""")


def plan_flags() -> str:
    return with_bindings("""
    SELECT (pv.touchless IS TRUE) AS touchless_true, (pv.enterprise IS FALSE) AS enterprise_false,
           count(*) AS n_orgs
    FROM organization AS g JOIN plan_variant AS pv ON g.billing_id = pv.customer_id
    GROUP BY 1, 2""")


def activity_group_counts() -> str:
    codes = [c for name in ("cards", "visits") for c in P.groups.groups[name]]
    return with_bindings(
        f"SELECT activity, count(*) AS n_events FROM user_activity WHERE activity IN {one_of(codes)} GROUP BY activity"
    )


def build() -> dict[str, str]:
    return {
        "calendar_spine_events": calendar_spine_events(),
        "exclusion_list_counts": exclusion_list_counts(),
        "exclusion_empty_list_counts": exclusion_empty_list_counts(),
        "not_exists_activity_counts": not_exists_activity_counts(),
        "json_text_values": json_text_values(),
        "external_ids": external_ids(),
        "heavy_users_having": heavy_users_having(),
        "daily_conditional_distinct": daily_conditional_distinct(),
        "org_filtered_counts": org_filtered_counts(),
        "top_org_per_activity": top_org_per_activity(),
        "daily_pairing": daily_pairing(),
        "product_fold_other": product_fold_other(),
        "org_error_share_band": org_error_share_band(),
        "days_since_first_event": days_since_first_event(),
        "licence_family_counts": licence_family_counts(),
        "plan_flags": plan_flags(),
        "activity_group_counts": activity_group_counts(),
    }
