"""Published versions of a domain warehouse.

A write puts every table into a folder of its own run, ``<table>/run=<id>``,
and then publishes a small JSON manifest that names the run of each table and
of each day of the activity fact. Readers take the newest manifest, so they
see a whole write or nothing of it; a write that is killed leaves the version
before it as it was. A write of some days names the earlier runs for the others.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFESTS = "_versions"


def _path(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder at any URI; none if it is missing."""
    where, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


@dataclass
class Version:
    """Run of each table; for the fact also the run of each day (``day`` column: its partition's name)."""

    tables: dict[str, str] = field(default_factory=dict)
    days: dict[str, str] = field(default_factory=dict)
    day_col: str = "event_date"

    def read(self, spark: SparkSession, root: str, table: str, schema: str) -> DataFrame:
        folder = f"{root.rstrip('/')}/{table}"
        if not self.days or table != "user_activity":
            return spark.read.schema(schema).parquet(f"{folder}/run={self.tables[table]}")
        paths = [f"{folder}/run={run}/{self.day_col}={day}" for day, run in sorted(self.days.items())]
        return spark.read.schema(schema).option("basePath", folder).parquet(*paths).drop("run")


def current_version(spark: SparkSession, root: str) -> Version | None:
    """The version published last under ``root``, if any."""
    folder = f"{root.rstrip('/')}/{MANIFESTS}"
    names = [n for n in listed(spark, folder) if n.endswith(".json")]
    if not names:
        return None
    text = "\n".join(r.value for r in spark.read.text(f"{folder}/{names[-1]}", wholetext=True).collect())
    return Version(**json.loads(text))


def new_run() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


def publish(spark: SparkSession, root: str, version: Version, run: str) -> None:
    """Make ``version`` the current one: written under a name that readers skip, then renamed."""
    folder = f"{root.rstrip('/')}/{MANIFESTS}"
    part, fs = _path(spark, f"{folder}/.{run}.tmp")
    out = fs.create(part, True)
    out.write(bytearray(json.dumps(vars(version)).encode()))
    out.close()
    final, _ = _path(spark, f"{folder}/{run}.json")
    if not fs.rename(part, final):
        raise OSError(f"version {run} could not be published under {folder}")


def days_of_run(spark: SparkSession, root: str, run: str, day_col: str) -> list[str]:
    names = listed(spark, f"{root.rstrip('/')}/user_activity/run={run}")
    return [n.partition("=")[2] for n in names if n.startswith(f"{day_col}=")]


def drop_old_runs(spark: SparkSession, root: str, keep: int = 2) -> list[str]:
    """Delete the folders that none of the last ``keep`` versions names; returns what was deleted.

    Readers that still hold an older version lose it, and a write that is not published yet would, too:
    run it when neither is under way.
    """
    base = root.rstrip("/")
    names = [n for n in listed(spark, f"{base}/{MANIFESTS}") if n.endswith(".json")]
    if not names:
        return []
    held: set[tuple[str, str]] = set()
    for name in names[-keep:]:
        text = "\n".join(r.value for r in spark.read.text(f"{base}/{MANIFESTS}/{name}", wholetext=True).collect())
        version = Version(**json.loads(text))
        held |= set(version.tables.items()) | {("user_activity", run) for run in version.days.values()}
    gone = []
    for table in {t for t, _ in held}:
        for entry in listed(spark, f"{base}/{table}"):
            if entry.startswith("run=") and (table, entry[4:]) not in held:
                where, fs = _path(spark, f"{base}/{table}/{entry}")
                fs.delete(where, True)
                gone.append(f"{table}/{entry}")
    for name in names[:-keep]:
        where, fs = _path(spark, f"{base}/{MANIFESTS}/{name}")
        fs.delete(where, False)
    return sorted(gone)


def activity_rows(df: DataFrame, day_col: str, splits: int) -> DataFrame:
    """The fact with its day, dealt by day and a spreading key and clustered by activity inside a file."""
    spread = F.pmod(F.xxhash64("user_id", "created"), F.lit(splits))
    return (
        df.withColumn(day_col, F.to_date("created"))
        .repartition(F.col(day_col), spread)
        .sortWithinPartitions(day_col, "activity", "user_id")
    )
