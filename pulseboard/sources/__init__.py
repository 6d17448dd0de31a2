"""Sources: Parquet/catalog readers and the domain bindings."""

from pulseboard.sources.bindings import (
    DOMAIN_TABLES,
    Domain,
    domain_from_catalog,
    domain_from_jdbc,
    domain_from_parquet,
    domain_from_testdata,
)
from pulseboard.sources.tables import read_table, driver_table, warehouse_table

__all__ = [
    "DOMAIN_TABLES",
    "Domain",
    "domain_from_catalog",
    "domain_from_jdbc",
    "domain_from_parquet",
    "domain_from_testdata",
    "read_table",
    "driver_table",
    "warehouse_table",
]
