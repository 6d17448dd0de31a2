"""Skew check: reports on an activity fact where one user and one
organisation hold a third of all rows.

The fact is derived by Spark from the test tables (``$BENCH_SF_DIR``,
default sf0.1): every row is copied ``$SKEW_COPIES`` times (default 30),
and rows with ``event_id % 3 = 0`` are moved to user 7 / organisation 1.
Automatic broadcasts are switched off so joins with users take the
sort-merge path they would take on large tables. For each report the
script prints the run time, the shuffle records read in the run and the
largest shuffle-reading stage (max / median records per task) from
Spark's event log. Scratch output goes to ``$SKEW_SCRATCH`` (a fresh local
folder by default; this is a single-machine check).
"""

from __future__ import annotations

import dataclasses
import glob
import json
import os
import statistics
import sys
import tempfile
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)


def main() -> None:
    from pyspark.sql import functions as F

    from pulseboard.plans import (
        daily_active_orgs,
        error_detail,
        most_active_touchless_orgs,
        top_org_per_error,
        trial_activity_by_product,
    )
    from pulseboard.plans.catalog import P, _domain
    from pulseboard.schemas import DOMAIN_SCHEMAS
    from pulseboard.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    copies = int(os.environ.get("SKEW_COPIES", "30"))
    scratch = os.environ.get("SKEW_SCRATCH") or tempfile.mkdtemp(prefix="pulseboard-skew-")
    events_dir = os.path.join(scratch, "eventlog")
    os.makedirs(events_dir, exist_ok=True)
    spark = build_session(
        "local[8]",
        32,
        extra={
            "spark.eventLog.enabled": "true",
            "spark.eventLog.dir": events_dir,
            "spark.eventLog.compress": "false",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m",
            "spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    base = _domain(spark, sf_dir)
    rows = base.user_activity.select("*", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("copy"))
    hot = F.col("event_id") % 3 == 0
    rows = rows.select(
        (F.col("event_id") * copies + F.col("copy")).alias("event_id"),
        F.when(hot, F.lit(7)).otherwise(F.col("user_id")).cast("bigint").alias("user_id"),
        F.when(hot, F.lit(1)).otherwise(F.col("organization_id")).cast("bigint").alias("organization_id"),
        "activity",
        "created",
        "payload",
    )
    fact_path = os.path.join(scratch, "user_activity")
    rows.repartition(32).write.mode("overwrite").parquet(fact_path)
    fact = spark.read.schema(DOMAIN_SCHEMAS["user_activity"]).parquet(fact_path)
    skewed = dataclasses.replace(base, user_activity=fact)
    n_rows = fact.count()
    n_hot = fact.filter("user_id = 7").count()

    reports = {
        "R1 daily_active_orgs": lambda d: daily_active_orgs(d, *P.r1, internal=P.internal, targets=P.targets),
        "R4 most_active_touchless_orgs": lambda d: most_active_touchless_orgs(
            d, *P.window, internal=P.internal, targets=P.targets
        ),
        "R7 top_org_per_error": lambda d: top_org_per_error(d, *P.window, P.errors, internal=P.internal),
        "R8 error_detail": lambda d: error_detail(d, *P.period, P.errors, internal=P.internal, meta_key="k"),
        "R14 trial_activity_by_product": lambda d: trial_activity_by_product(
            d, *P.window, P.excluded_activities, internal=P.internal, trial=P.trial
        ),
    }
    spans = {}
    for name, build in reports.items():
        build(skewed).write.format("noop").mode("overwrite").save()  # warm-up
        t0 = int(time.time() * 1000)
        build(skewed).write.format("noop").mode("overwrite").save()
        spans[name] = (t0, int(time.time() * 1000))
    spark.stop()

    tasks: dict[int, list[tuple[int, int, int]]] = {}
    for path in glob.glob(os.path.join(events_dir, "**"), recursive=True):
        if not os.path.isfile(path):
            continue
        for line in open(path, errors="replace"):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if e.get("Event") == "SparkListenerTaskEnd":
                info, metrics = e["Task Info"], e.get("Task Metrics") or {}
                read = (metrics.get("Shuffle Read Metrics") or {}).get("Total Records Read", 0)
                tasks.setdefault(e["Stage ID"], []).append(
                    (info["Finish Time"] - info["Launch Time"], read, info["Launch Time"])
                )

    print(f"fact rows {n_rows}, rows of the hot user/organisation {n_hot}")
    for name, (a, b) in spans.items():
        in_run = {sid: ts for sid, ts in tasks.items() if a <= min(t[2] for t in ts) <= b}
        total = sum(t[1] for ts in in_run.values() for t in ts)
        worst = max(in_run.items(), key=lambda kv: max(t[1] for t in kv[1]), default=None)
        line = f"{name:32s} {(b - a) / 1000:6.2f} s  shuffle records read {total:9d}"
        if worst:
            recs = [t[1] for t in worst[1]]
            line += (
                f"  largest stage: {len(recs)} tasks, max {max(recs)} / median "
                f"{statistics.median(recs):.0f} records"
            )
        print(line)


if __name__ == "__main__":
    main()
