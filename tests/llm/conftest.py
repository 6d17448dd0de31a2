from __future__ import annotations

import pytest

from tests.llm import cases


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(cases.documents(), cases.SCHEMA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="session")
def bench(spark):
    return spark.createDataFrame(cases.benchmark(), "item_id long, text string")


def by_text(df, docs):
    """Sorted rows as tuples, None before everything."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple((x is not None, str(x)) for x in r))
