"""Row predicates and scalar helpers on inline rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulseboard.functions.predicates import (
    is_false,
    is_true,
    keep_external,
    matches_family,
    not_excluded,
    not_in_list_keep_null,
)
from pulseboard.functions.text import band, fold_other, product_of
from pulseboard.functions.time import day_of, format_utc, ts_lit
from pulseboard.params import InternalRule
from tests.conftest import ts


def _vals(spark, data, schema, expr):
    df = spark.createDataFrame(data, schema)
    return [r[0] for r in df.select(expr.alias("v")).collect()]


def test_exclusion_empty_list_keeps_null(spark):
    got = _vals(spark, [(None,), (1,), (7,)], "org BIGINT", not_excluded("org", []))
    assert got == [True, True, True]


def test_exclusion_list_drops_null_as_unknown(spark):
    df = spark.createDataFrame([(None,), (1,), (7,)], "org BIGINT")
    kept = [r.org for r in df.filter(not_excluded("org", [1])).collect()]
    assert kept == [7]


def test_internal_rule_with_exempt_org(spark):
    rule = InternalRule(pattern="%@corp.example", exempt_org=1)
    data = [
        (1, None),
        (2, None),
        (1, "a@corp.example"),
        (2, "a@corp.example"),
        (2, "b@else.example"),
    ]
    df = spark.createDataFrame(data, "org BIGINT, username STRING")
    kept = [tuple(r) for r in df.filter(keep_external("org", "username", rule)).collect()]
    assert kept == [(1, None), (1, "a@corp.example"), (2, "b@else.example")]


def test_internal_rule_without_exemption(spark):
    rule = InternalRule(pattern="%corp%", exempt_org=None)
    df = spark.createDataFrame([(1, "x@corp.y"), (1, None), (2, "z@ok")], "org BIGINT, username STRING")
    assert [r.username for r in df.filter(keep_external("org", "username", rule)).collect()] == ["z@ok"]


def test_not_exists_keeps_null(spark):
    df = spark.createDataFrame([(None,), ("A_CLICK",), ("A_VIEW",)], "a STRING")
    kept = [r.a for r in df.filter(not_in_list_keep_null("a", ["A_CLICK"])).collect()]
    assert kept == [None, "A_VIEW"]
    assert df.filter(not_in_list_keep_null("a", [])).count() == 3


def test_is_true_is_false_three_valued(spark):
    got = _vals(spark, [(True,), (False,), (None,)], "b BOOLEAN", is_true("b"))
    assert got == [True, False, False]
    got = _vals(spark, [(True,), (False,), (None,)], "b BOOLEAN", is_false("b"))
    assert got == [False, True, False]


def test_family_like_and_equal(spark):
    data = [("VISIT_REPORT",), ("DATA_QUALITY",), ("GRABBER_X",), ("OTHER",), (None,)]
    got = _vals(spark, data, "n STRING", matches_family("n", ["GRABBER"], ["DATA_QUALITY"]))
    assert got == [False, True, True, False, None]


def test_bands_edges(spark):
    data = [(4.999,), (5.0,), (9.999,), (10.0,), (None,)]
    got = _vals(spark, data, "x DOUBLE", band("x", 10.0, 5.0))
    assert got == ["low", "medium", "medium", "high", None]


def test_product_prefix_and_fold(spark):
    data = [("BCS_CARDS",), ("LOGIN_VIEW",), ("VR",), (None,), ("",)]
    got = _vals(spark, data, "a STRING", product_of("a"))
    assert got == ["BCS", "LOGIN", "VR", None, ""]
    got = _vals(spark, data, "a STRING", fold_other(product_of("a"), ["BCS", "VR"], "OTHER"))
    assert got == ["BCS", "OTHER", "VR", "OTHER", "OTHER"]


def test_time_helpers(spark):
    df = spark.createDataFrame([(ts("2024-01-05 13:04:05"),)], "t TIMESTAMP_NTZ")
    r = df.select(format_utc("t"), day_of("t"), (F.col("t") > ts_lit("2024-01-05")).alias("after")).first()
    assert r[0] == "2024-01-05, 13:04:05 UTC"
    assert str(r[1]) == "2024-01-05"
    assert r[2] is True
