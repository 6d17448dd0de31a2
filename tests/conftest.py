from __future__ import annotations

import os
import sys
from datetime import datetime

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from pulseboard.schemas import DOMAIN_SCHEMAS  # noqa: E402
from pulseboard.session import build_session, ensure_checkpoint_dir  # noqa: E402
from pulseboard.sources.bindings import DOMAIN_TABLES, Domain  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[*]", 8, app_name="pulseboard-tests")
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s
    s.stop()


def ts(text: str) -> datetime:
    return datetime.fromisoformat(text)


class DomainBuilder:
    """Inline domain frames: ``make(user_activity=[...], user=[...])``; tables
    left out are empty. Rows are tuples in the column order of DOMAIN_SCHEMAS."""

    def __init__(self, spark):
        self.spark = spark

    def make(self, **tables) -> Domain:
        frames = {}
        for name in DOMAIN_TABLES:
            rows = tables.get(name, [])
            frames[name] = self.spark.createDataFrame(rows, DOMAIN_SCHEMAS[name])
        return Domain(**frames)


@pytest.fixture(scope="session")
def dom(spark):
    return DomainBuilder(spark)


def rows(df, *cols):
    """Collected rows as plain tuples (all or selected columns)."""
    sel = df.select(*cols) if cols else df
    return [tuple(r) for r in sel.collect()]
