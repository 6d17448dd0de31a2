"""Cross-system id resolution for organisations.

billing id = coalesce(billing profile id, first 24 chars of the CRM profile's
billing reference); CRM id = coalesce(JSON key of the billing profile's
custom fields, CRM profile id).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseboard.params import BILLING_ID_LENGTH, CRM_ID_JSON_KEY


def org_external_ids(
    organization: DataFrame,
    billing_profile: DataFrame,
    crm_profile: DataFrame,
    json_key: str = CRM_ID_JSON_KEY,
    id_length: int = BILLING_ID_LENGTH,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One row per organisation x matching profile pair (both joins optional).

    Columns: organization_id, org_name, bw_org_id, hs_org_id, and those to ``keep``. An organisation
    with several matching profile rows yields several rows, exactly like the
    two LEFT JOINs it replaces. Only dimension tables are touched here; the
    fact side joins the (small) result after it has been aggregated.
    """
    org = organization.select(
        "organization_id", F.col("name").alias("org_name"), "billing_id", "crm_id", *keep
    )
    bw = billing_profile.select(F.col("id").alias("bw_id"), F.col("customfields").alias("bw_fields"))
    hs = crm_profile.select(F.col("id").alias("hs_id"), F.col("billing_customer_id").alias("hs_bw_ref"))
    joined = org.join(bw, org.billing_id == bw.bw_id, "left").join(hs, org.crm_id == hs.hs_id, "left")
    return joined.select(
        "organization_id",
        "org_name",
        F.coalesce(F.col("bw_id"), F.substring("hs_bw_ref", 1, id_length)).alias("bw_org_id"),
        F.coalesce(F.get_json_object("bw_fields", f"$.{json_key}"), F.col("hs_id")).alias("hs_org_id"),
        *keep,
    )


def org_external_ids_weighted(ext: DataFrame) -> DataFrame:
    """Collapse :func:`org_external_ids` rows to distinct (org, name, ids) with
    the number of profile rows behind each (``ext_mult``).

    Reports that count fact rows multiply by ``ext_mult``: the same count the
    row-level left joins would give, without joining facts to profiles.
    """
    return ext.groupBy("organization_id", "org_name", "bw_org_id", "hs_org_id").agg(
        F.count(F.lit(1)).alias("ext_mult")
    )
