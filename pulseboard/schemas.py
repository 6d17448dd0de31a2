"""Declared schemas: the domain tables and the driver's test tables.

Reading Parquet with a declared schema skips footer inference (a Spark job
per read) and pins the types the reports are written against.
"""

from __future__ import annotations

from pyspark.sql import types as T

DOMAIN_SCHEMAS: dict[str, str] = {
    "user_activity": "event_id BIGINT, user_id BIGINT, organization_id BIGINT, activity STRING, "
    "created TIMESTAMP_NTZ, payload STRING",
    "user": "user_id BIGINT, username STRING, organization_id BIGINT, is_deleted BOOLEAN",
    "organization": "organization_id BIGINT, name STRING, billing_id STRING, crm_id STRING",
    "org_subscription": "org_subscription_id BIGINT, organization_id BIGINT, subscription_type_id INT, "
    "max_users INT, valid_from TIMESTAMP_NTZ, valid_until TIMESTAMP_NTZ",
    "subscription_type": "subscription_type_id INT, name STRING",
    "user_license": "user_id BIGINT, org_subscription_id BIGINT, assigned_at TIMESTAMP_NTZ, "
    "unassigned_at TIMESTAMP_NTZ",
    "plan_variant": "customer_id STRING, touchless BOOLEAN, enterprise BOOLEAN",
    "billing_profile": "id STRING, customfields STRING",
    "crm_profile": "id STRING, billing_customer_id STRING",
}

TEST_SCHEMAS: dict[str, str] = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, "
    "props STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
}


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
