"""Stored daily roll-ups of the activity fact.

* :func:`write_activity_counts` keeps one row per (day, user, organisation,
  activity) with its events and last time. Reports on a domain that has it
  (``activity_counts``) merge its days and read the fact only for the part days
  at the ends of their window (:meth:`Domain.counted`).
* :func:`write_daily_distinct` keeps, per day and activity, the set of
  organisations (or users) as exact bitmaps. Sets of days merge by OR, so a
  distinct count over any window needs neither the fact nor the roll-up.

Both are partitioned by day and overwrite only the days they are given, so
running a day again changes nothing and late events are taken in by it.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseboard.functions.time import date_lit
from pulseboard.operators.rollup import with_user_rule
from pulseboard.params import InternalRule
from pulseboard.sources.bindings import Domain

COUNTS_SCHEMA = "user_id BIGINT, organization_id BIGINT, activity STRING, n BIGINT, last_at TIMESTAMP_NTZ, day DATE"
DISTINCT_SCHEMA = "activity STRING, bucket BIGINT, bits BINARY, day DATE"
EMPTY_DAY = "__HIVE_DEFAULT_PARTITION__"


def _days(events: DataFrame, days: Iterable[date] | None) -> DataFrame:
    if days is None:
        return events
    wanted = [date_lit(x) for x in days]
    return events.filter(F.to_date("created").isin(wanted) if wanted else F.lit(False))


def _events(d: Domain, days: Iterable[date] | None) -> DataFrame:
    listed = None if days is None else sorted(days)
    if not listed:
        return _days(d.user_activity, listed)
    # Bounds on the time prune the fact's partitions.
    return _days(d.activity(listed[0]).filter(F.col("created") < F.date_add(date_lit(listed[-1]), 1).cast("timestamp_ntz")), listed)


def activity_counts(d: Domain, days: Iterable[date] | None = None) -> DataFrame:
    """(user_id, organization_id, activity, n, last_at, day) of the fact, or of some of its days."""
    return _events(d, days).groupBy("user_id", "organization_id", "activity", F.to_date("created").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.max("created").alias("last_at")
    ).select("user_id", "organization_id", "activity", "n", "last_at", "day")


def write_activity_counts(d: Domain, root: str, days: Iterable[date] | None = None, day_splits: int = 8) -> None:
    """Store :func:`activity_counts` under ``root``, replacing the days written."""
    rows = activity_counts(d, days)
    spread = F.pmod(F.xxhash64("user_id", "activity"), F.lit(day_splits))
    dealt = rows.repartition(F.col("day"), spread).sortWithinPartitions("day", "activity", "user_id")
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)


def read_activity_counts(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(COUNTS_SCHEMA).parquet(root)


# ------------------------------------------------------- exact distinct counts
def daily_distinct(
    d: Domain,
    value: str = "organization_id",
    activities: Iterable[str] | None = None,
    internal: InternalRule | None = None,
    days: Iterable[date] | None = None,
) -> DataFrame:
    """(activity, bucket, bits, day): the distinct ``value`` ids of each day and activity.

    A bitmap holds 32,768 neighbouring ids, so dense ids need few of them. The
    user rule is applied first (whose organisation it exempts is known here);
    unknown ids are in no set.
    """
    events = _events(d, days)
    if activities is not None:
        events = events.filter(F.col("activity").isin(list(activities)))
    per_user = events.select("user_id", "organization_id", "activity", F.to_date("created").alias("day")).distinct()
    ids = with_user_rule(per_user, d.user, internal).filter(F.col(value).isNotNull()).select("day", "activity", value).distinct()
    place = F.bitmap_bucket_number(value).alias("bucket")
    return ids.groupBy("day", "activity", place).agg(F.bitmap_construct_agg(F.bitmap_bit_position(value)).alias("bits")).select(
        "activity", "bucket", "bits", "day"
    )


def write_daily_distinct(d: Domain, root: str, days: Iterable[date] | None = None, **what) -> None:
    """Store :func:`daily_distinct` under ``root``, replacing the days written."""
    rows = daily_distinct(d, days=days, **what).repartition("day")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(root)


def read_daily_distinct(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(DISTINCT_SCHEMA).parquet(root)


def merged_distinct(sets: DataFrame, keys: Iterable[str | Column], conditions: Mapping[str, Column | None]) -> DataFrame:
    """Distinct ids per ``keys``, one count per condition on the sets (None: all of them).

    Bitmaps of one bucket are OR-ed before they are counted, so an id of several
    days or activities counts once. ``keys`` may be empty (the whole window).
    """
    keys = list(keys)
    named = [k if isinstance(k, str) else f"__k{i}" for i, k in enumerate(keys)]
    rows = reduce(lambda df, p: df.withColumn(p[0], p[1]), [(n, k) for n, k in zip(named, keys) if not isinstance(k, str)], sets)
    ors = [F.bitmap_or_agg(F.col("bits") if c is None else F.when(c, F.col("bits"))).alias(name) for name, c in conditions.items()]
    per_bucket = rows.groupBy(*named, "bucket").agg(*ors)
    return per_bucket.groupBy(*named).agg(*[F.sum(F.bitmap_count(name)).alias(name) for name in conditions])
