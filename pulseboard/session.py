"""SparkSession settings the reports rely on."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every report assumes. Time zone: the reports print UTC wall-clock
# times and compare naive timestamps, so the session zone is pinned.
REPORT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
}


def apply_report_conf(spark: SparkSession) -> SparkSession:
    """Set the session-level options the reports need on an existing session."""
    for key, value in REPORT_CONF.items():
        spark.conf.set(key, value)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that ``spark.checkpoint.dir`` names.

    A session on one machine may run without the setting and gets a temporary
    folder; any other session without it is refused.
    """
    sc = spark.sparkContext
    current = sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        current = tempfile.mkdtemp(prefix="pulseboard-ckpt-")
    sc.setCheckpointDir(current)
    return current


def build_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "pulseboard",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the report settings.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster
    leave them ``None`` so the deployment's values apply.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = builder.config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    for key, value in REPORT_CONF.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    driver_mem = os.environ.get("PULSEBOARD_DRIVER_MEMORY")
    if driver_mem:
        builder = builder.config("spark.driver.memory", driver_mem)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    apply_report_conf(spark)
    return spark
