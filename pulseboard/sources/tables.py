"""Table readers.

``read_table`` reads one Parquet table lazily; Catalyst prunes columns and
pushes filters into the scan, so readers never pre-select columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TEST_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def driver_table(root: str, name: str) -> str:
    """Where the driver's test tables lie: ``root/name.parquet``."""
    return f"{root.rstrip('/')}/{name}.parquet"


def warehouse_table(root: str, name: str) -> str:
    """Where ``write_domain`` stores a domain table: ``root/name``."""
    return f"{root.rstrip('/')}/{name}"


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Lazy Parquet read of any URI; a declared ``schema`` (DDL) skips footer inference."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)
