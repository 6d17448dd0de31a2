"""The registered queries against their SQL on the smallest test tables."""

from __future__ import annotations

import pytest

from pulseboard.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import SF001, SF01
from tests.oracle_check import compare, duck_connect


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_duckdb(spark, name):
    r = compare(spark, duck_connect(SF001), name, QUERIES[name], ORACLE_SQL[name], SF001)
    assert r["cols_match"] and r["rows"][0] == r["rows"][1] and r["hash"][0] == r["hash"][1]


def test_mined_rules_decide_pages_with_derived_labels(spark):
    """At sf0.01 the labels of the contract give no rule, those that follow from the URL give some."""
    by_label = lambda name: QUERIES[name](spark, SF01).where("rule IS NULL AND verdict = 'block'").count()
    assert by_label("op7_url_rules") == 0 and by_label("url_rules_on_derived_labels") > 0
    name = "url_rules_on_derived_labels"
    r = compare(spark, duck_connect(SF01), name, QUERIES[name], ORACLE_SQL[name], SF01)
    assert r["cols_match"] and r["rows"][0] == r["rows"][1] and r["hash"][0] == r["hash"][1]
