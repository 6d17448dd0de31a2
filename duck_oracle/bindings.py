"""DuckDB twins of the test-table bindings (same expressions as
``pulseboard.sources.bindings.domain_from_testdata``), as CTE text."""

from __future__ import annotations

from pulseboard.params import CRM_ID_JSON_KEY

# name -> SQL body. Order matters: later CTEs may read earlier ones.
BINDINGS: dict[str, str] = {
    "user_activity": """
        SELECT e.event_id,
               CASE WHEN e.event_id % 29 <> 0 THEN e.user_id END AS user_id,
               CASE WHEN e.event_id % 31 <> 0 THEN CAST(e.user_id AS BIGINT) // 10 END AS organization_id,
               CASE WHEN e.event_id % 37 <> 0 THEN
                   (CASE e.event_id % 5 WHEN 0 THEN 'BCS' WHEN 1 THEN 'GRABBER'
                        WHEN 2 THEN 'EXPORT' WHEN 3 THEN 'VR' WHEN 4 THEN 'LOGIN' END)
                       || '_' || upper(e.event_type) END AS activity,
               e.ts AS created,
               e.props AS payload
        FROM events AS e JOIN customer AS c ON e.user_id = c.c_custkey""",
    "users": """
        SELECT c_custkey AS user_id,
               c_name AS username,
               CAST(c_custkey AS BIGINT) // 10 AS organization_id,
               c_acctbal < 0 AS is_deleted
        FROM customer""",
    "org_keys": """
        SELECT DISTINCT CAST(c_custkey AS BIGINT) // 10 AS k FROM customer""",
    "organization": """
        SELECT k AS organization_id,
               'Org ' || CAST(k AS VARCHAR) AS name,
               CASE WHEN k % 17 <> 0 THEN 'bw-' || CAST(k AS VARCHAR) END AS billing_id,
               'hs-' || CAST(k AS VARCHAR) AS crm_id
        FROM org_keys""",
    "org_subscription": """
        SELECT o.o_orderkey AS org_subscription_id,
               CAST(c.c_custkey AS BIGINT) // 10 AS organization_id,
               CAST(substr(o.o_orderpriority, 1, 1) AS INTEGER) AS subscription_type_id,
               CAST(o.o_orderkey % 3 + 1 AS INTEGER) AS max_users,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o.o_orderkey % 30 AS INTEGER)) AS valid_from,
               TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(o.o_orderkey % 30 AS INTEGER))
                   + INTERVAL 60 DAY AS valid_until
        FROM orders AS o JOIN customer AS c ON o.o_custkey = c.c_custkey""",
    "subscription_type": """
        SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS subscription_type_id,
               substr(o_orderpriority, 3) AS name
        FROM orders""",
    "user_license": """
        SELECT o.o_custkey AS user_id,
               l.l_orderkey AS org_subscription_id,
               l.l_shipdate AS assigned_at,
               CASE WHEN l.l_returnflag = 'R' THEN l.l_shipdate END AS unassigned_at
        FROM lineitem AS l JOIN orders AS o ON l.l_orderkey = o.o_orderkey""",
    "plan_variant": """
        SELECT 'bw-' || CAST(k AS VARCHAR) AS customer_id,
               CASE WHEN k % 7 <> 0 THEN k % 5 IN (0, 1, 2) END AS touchless,
               CASE WHEN k % 11 <> 0 THEN k % 5 = 2 END AS enterprise
        FROM org_keys""",
    "billing_profile": """
        SELECT (CASE WHEN s_suppkey % 2 = 0 THEN 'bw-' ELSE 'bx-' END) || CAST(s_suppkey AS VARCHAR) AS id,
               '{"' || '%(key)s' || '": "h' || CAST(s_suppkey AS VARCHAR) || '"}' AS customfields
        FROM supplier""",
    "crm_profile": """
        SELECT (CASE WHEN c_custkey % 3 <> 0 THEN 'hs-' ELSE 'hx-' END) || CAST(c_custkey AS VARCHAR) AS id,
               c_name || '-' || c_mktsegment AS billing_customer_id
        FROM customer""",
}


def with_bindings(body: str, **extra: str) -> str:
    """Prefix ``body`` (a SELECT) with every binding, then ``extra``, as CTEs."""
    bindings = {k: v.replace("%(key)s", CRM_ID_JSON_KEY) for k, v in BINDINGS.items()}
    parts = {**bindings, **extra}
    ctes = ",\n".join(f"{name} AS ({sql}\n)" for name, sql in parts.items())
    return f"WITH {ctes}\n{body}"
