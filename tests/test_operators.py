"""Operators on small frames, against hand-computed rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from pulseboard.operators.calendar import Series, attach_daily, attach_detail, day_spine
from pulseboard.operators.counts import distinct_count_by, weighted_count_where
from pulseboard.operators.densify import densify_days
from pulseboard.operators.multiplicity import multiplicity
from pulseboard.operators.period import pair_with_previous
from pulseboard.operators.topk import top1_per_group
from pulseboard.params import PeriodPair
from tests.conftest import rows

D = date.fromisoformat


def test_series_and_spine(spark):
    s = Series.between("2024-01-01", "2024-01-03T12:00:00")
    assert (s.first_day, s.n_points, s.aligned) == (D("2024-01-01"), 3, True)
    assert Series.between("2024-01-03", "2024-01-01").n_points == 0
    assert not Series.between("2024-01-01T01:00:00", "2024-01-02").aligned
    assert rows(day_spine(spark, s)) == [(D("2024-01-01"),), (D("2024-01-02"),), (D("2024-01-03"),)]
    empty = day_spine(spark, Series.days(D("2024-01-05"), D("2024-01-01")))
    assert empty.count() == 0 and empty.dtypes == [("day", "date")]


def test_attach_daily_and_detail(spark):
    s = Series.days(D("2024-01-01"), D("2024-01-03"))
    daily = spark.createDataFrame([(D("2024-01-02"), 5)], "day DATE, n BIGINT")
    assert rows(attach_daily(day_spine(spark, s), daily, s).orderBy("day")) == [
        (D("2024-01-01"), None), (D("2024-01-02"), 5), (D("2024-01-03"), None)
    ]
    detail = spark.createDataFrame(
        [(D("2024-01-02"), "a"), (D("2024-01-02"), "b")], "day DATE, v STRING"
    )
    out = rows(attach_detail(day_spine(spark, s), detail, s).orderBy("day", "v"))
    assert out == [(D("2024-01-01"), None), (D("2024-01-02"), "a"), (D("2024-01-02"), "b"), (D("2024-01-03"), None)]


def test_distinct_count_by_conditions_and_nulls(spark):
    df = spark.createDataFrame(
        [(1, 10, "x"), (1, 10, "y"), (1, 11, "y"), (1, None, "x"), (2, 12, "z")],
        "g INT, org BIGINT, a STRING",
    )
    out = distinct_count_by(df, ["g"], "org", {"all": None, "x": F.col("a") == "x", "y": F.col("a") == "y"})
    assert sorted(rows(out)) == [(1, 2, 1, 2), (2, 1, 0, 0)]


def test_weighted_count_where_zero_not_null(spark):
    df = spark.createDataFrame([(1, None, 3), (1, "A", 2), (2, None, 4)], "g INT, name STRING, n BIGINT")
    out = df.groupBy("g").agg(weighted_count_where(F.col("name").isNotNull(), "n").alias("c"))
    assert sorted(rows(out)) == [(1, 2), (2, 0)]


def test_densify_keeps_categories_of_out_of_range_days(spark):
    df = spark.createDataFrame([("A", 0, 9), ("A", 2, 5), ("B", -3, 1)], "k STRING, day_nr INT, c BIGINT")
    out = rows(densify_days(df, "k", "day_nr", "c", 3).orderBy("k", "day_nr"))
    assert out == [(1, "A", 0), (2, "A", 5), (3, "A", 0), (1, "B", 0), (2, "B", 0), (3, "B", 0)]


def test_pair_with_previous_offsets(spark):
    pair = PeriodPair.of("2024-01-10", "2024-01-12")  # N = 2, series 01-09 .. 01-12
    daily = spark.createDataFrame(
        [(D("2024-01-09"), 1), (D("2024-01-10"), 2), (D("2024-01-11"), 3), (D("2024-01-12"), 4)],
        "day DATE, n BIGINT",
    )
    assert rows(pair_with_previous(daily, pair, ["n"]).orderBy("day")) == [
        (D("2024-01-11"), 3, D("2024-01-09"), 1),
        (D("2024-01-12"), 4, D("2024-01-10"), 2),
    ]


def test_top1_and_multiplicity(spark):
    df = spark.createDataFrame([("e", 2, 5), ("e", 1, 5), ("e", 3, 1), ("f", 9, 1)], "a STRING, o INT, n INT")
    out = top1_per_group(df, ["a"], [F.col("n").desc(), F.col("o").asc()])
    assert sorted(rows(out)) == [("e", 1, 5), ("f", 9, 1)]
    assert sorted(rows(multiplicity(df, ["a"]))) == [("e", 3), ("f", 1)]


def test_activity_groups_concatenate_in_order():
    from pulseboard.params import ActivityGroups

    g = ActivityGroups({"a": ("X_1", "X_2"), "b": ("Y_1", "X_2"), "c": ()})
    assert g.codes("a", "b", "c") == ["X_1", "X_2", "Y_1"]
    assert g.codes("b") == ["Y_1", "X_2"]
