"""Registered runs on what the sinks store: the warehouse, the fact's daily
roll-up and the daily bitmaps of its organisations.

Each run writes its tables into a fresh folder of the session's shared folder
(``spark.checkpoint.dir``) and reads them back, so it starts jobs when built.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseboard.plans import usage
from pulseboard.plans.catalog import REPORTS_ON_DOMAIN, P, _domain
from pulseboard.session import ensure_checkpoint_dir
from pulseboard.sources.bindings import DOMAIN_TABLES, Domain, domain_from_parquet
from pulseboard.sources.daily import read_activity_counts, read_daily_distinct, write_activity_counts, write_daily_distinct
from pulseboard.sources.warehouse import DAY_COL, write_domain


def _folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/pulseboard-{name}-{uuid.uuid4().hex}"


def with_counts(d: Domain, root: str) -> Domain:
    """The domain with its roll-up stored under ``root``."""
    write_activity_counts(d, root)
    return d.replace(activity_counts=lambda: read_activity_counts(d.spark, root))


def _on_counts(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return REPORTS_ON_DOMAIN[name](with_counts(_domain(spark, sf_dir), _folder(spark, "counts")))

    return run


def _sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _folder(spark, "sets")
    write_daily_distinct(_domain(spark, sf_dir), root, activities=P.targets.codes.values(), internal=P.internal)
    return read_daily_distinct(spark, root)


def active_orgs_whole_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.active_orgs_of_days(_sets(spark, sf_dir), *P.whole_days, targets=P.targets)


def active_orgs_of_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage.active_orgs_of_window(_sets(spark, sf_dir), *P.whole_days, targets=P.targets)


def warehouse_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table read back from the sink; the fact's by day, with its distinct users."""
    root = _folder(spark, "warehouse")
    write_domain(_domain(spark, sf_dir), root)
    back = domain_from_parquet(spark, root)
    n = F.count(F.lit(1)).alias("n_rows")
    fact = back.user_activity.groupBy(F.lit("user_activity").alias("table_name"), F.col(DAY_COL).alias("day"))
    parts = [fact.agg(n, F.count_distinct("user_id").alias("n_users"))]
    for name in DOMAIN_TABLES:
        if name != "user_activity":
            rows = getattr(back, name).agg(n)
            none = F.lit(None)
            parts.append(rows.select(F.lit(name).alias("table_name"), none.cast("date").alias("day"), "n_rows", none.cast("bigint").alias("n_users")))
    return reduce(DataFrame.unionByName, parts)


FROM_COUNTS = ("daily_active_orgs", "daily_active_orgs_midday_end", "most_active_touchless_orgs", "slipping_away_orgs", "top_org_per_error")
STORED_RUNS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{f"{name}_from_counts": _on_counts(name) for name in FROM_COUNTS},
    "active_orgs_whole_days": active_orgs_whole_days,
    "active_orgs_of_window": active_orgs_of_window,
    "warehouse_round_trip": warehouse_round_trip,
}
