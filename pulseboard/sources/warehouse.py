"""Domain warehouse sink: store the nine domain frames as Parquet.

The activity fact is written partitioned by event day, so the reports' time
windows prune whole directories, and clustered by activity inside a day, so a
report on a few activity codes skips the other row groups. Read back with
:func:`pulseboard.sources.bindings.domain_from_parquet`.
:func:`write_domain_catalog` also buckets the fact and the users by user.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseboard.sources.bindings import DOMAIN_TABLES, Domain
from pulseboard.sources.tables import warehouse_table
from pulseboard.sources.versions import Version, activity_rows, current_version, days_of_run, listed, new_run, publish

DAY_COL = "event_date"
#: Parquet's own Bloom filter of the activity codes of a row group, for codes between its least and greatest one.
ACTIVITY_BLOOM = {"parquet.bloom.filter.enabled#activity": "true", "parquet.bloom.filter.expected.ndv#activity": "10000"}


def write_domain(
    domain: Domain,
    root: str,
    mode: str = "errorifexists",
    day_col: str = DAY_COL,
    day_splits: int = 32,
    rows_per_file: int = 4_000_000,
) -> str:
    """Write every domain table under ``root`` (any URI Spark writes) and then
    publish them together as one version; returns its run id.

    The fact is dealt by day and a spreading key of the row, so a heavy day is
    written by up to ``day_splits`` tasks and a day has at most that many files
    (more only where a file reaches ``rows_per_file``). Other tables keep their
    partitioning. With ``mode="overwrite"`` the fact replaces only the days
    that are written (all of a domain that was written without versions). Readers see the version before until the last table is
    written, and keep it if the write is killed.
    """
    spark = domain.spark
    before = current_version(spark, root)
    # What a killed write left is no domain; files beside the runs are one that was written without versions.
    plain = [n for n in listed(spark, warehouse_table(root, "user_activity")) if not n.startswith("run=")]
    if (before is not None or plain) and mode != "overwrite":
        raise FileExistsError(f"a domain already exists under {root}; write with mode='overwrite'")
    run = new_run()
    for name in DOMAIN_TABLES:
        df = getattr(domain, name)
        path = f"{warehouse_table(root, name)}/run={run}"
        if name == "user_activity":
            writer = activity_rows(df, day_col, day_splits).write.partitionBy(day_col).options(**ACTIVITY_BLOOM)
            writer.option("maxRecordsPerFile", rows_per_file).parquet(path)
        else:
            df.write.parquet(path)
    written = {day: run for day in days_of_run(spark, root, run, day_col)}
    days = {**(before.days if before is not None else {}), **written}
    publish(spark, root, Version({name: run for name in DOMAIN_TABLES}, days, day_col), run)
    return run


def write_domain_catalog(
    domain: Domain,
    database: str,
    root: str,
    buckets: int = 64,
    mode: str = "errorifexists",
    day_col: str = DAY_COL,
    tasks: int | None = None,
) -> None:
    """Write the domain as catalog tables ``database.<table>`` stored under
    ``root/<table>``, with the activity fact partitioned by day and both the
    fact and the users bucketed by ``user_id`` into the same number of buckets;
    licences and subscriptions are bucketed by the subscription key.

    The reports roll the fact up per (user, organisation, ...) and then join
    users on ``user_id``: on this layout the roll-up finds its input already
    clustered by user and the join is bucket to bucket, so neither shuffles.
    Licence reports join licences to subscriptions on the subscription key,
    again bucket to bucket. Inside a file the fact is sorted by activity, so
    that row groups of other codes are skipped.

    The fact is written by ``tasks`` ranges (by default the session's shuffle
    partitions) of about equal size over (day, bucket): a user with most of a
    day's events is written by several tasks, and there are at most days x
    buckets + tasks files.
    Read back with :func:`pulseboard.sources.bindings.domain_from_catalog`.
    """
    spark = domain.spark
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{warehouse_table(root, '_database')}'")
    for name in DOMAIN_TABLES:
        df = getattr(domain, name)
        writer_df = df
        if name == "user_activity":
            # ranges of (day, bucket): a heavy one spans several tasks, light ones share a task
            bucket = F.pmod(F.hash("user_id"), F.lit(buckets))
            spread = F.xxhash64("created", "event_id", "activity")
            ranges = [F.col(day_col), bucket, spread]
            dated = df.withColumn(day_col, F.to_date("created"))
            writer_df = dated.repartitionByRange(*([tasks] if tasks else []), *ranges)
        elif name == "user":
            writer_df = df.repartition(buckets, "user_id")
        elif name in ("user_license", "org_subscription"):
            writer_df = df.repartition(buckets, "org_subscription_id")
        writer = writer_df.write.mode(mode).option("path", warehouse_table(root, name))
        if name == "user_activity":
            writer = writer.partitionBy(day_col).bucketBy(buckets, "user_id").sortBy("activity", "user_id")
            writer = writer.options(**ACTIVITY_BLOOM)
        elif name == "user":
            writer = writer.bucketBy(buckets, "user_id").sortBy("user_id")
        elif name in ("user_license", "org_subscription"):
            writer = writer.bucketBy(buckets, "org_subscription_id").sortBy("org_subscription_id")
        writer.saveAsTable(f"{database}.{name}")
