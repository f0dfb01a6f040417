from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from monthgrid.operators import joins
from monthgrid.session import assert_none, assert_unique

D = datetime.date


def test_asof_is_strict_and_ignores_later_revisions(spark):
    left = spark.createDataFrame([("a", D(2023, 2, 1)), ("a", D(2023, 4, 1)), ("a", D(2023, 3, 1)), ("b", D(2023, 4, 1)), (None, D(2023, 4, 1))], "mo string, period date")
    right = spark.createDataFrame([("a", D(2023, 1, 31), 1000.5), ("a", D(2023, 3, 1), 1100.5), ("b", D(2023, 4, 1), 5.0)], "mo string, released date, v double")
    got = {(r.mo, r.period): r.v for r in joins.asof_strict(left, right, ["mo"], "period", "released", "v").collect()}
    assert got == {("a", D(2023, 2, 1)): 1000.5, ("a", D(2023, 3, 1)): 1000.5, ("a", D(2023, 4, 1)): 1100.5, ("b", D(2023, 4, 1)): None, (None, D(2023, 4, 1)): None}


def test_lagged_attach_keeps_a_missing_month_missing(spark):
    panel = spark.createDataFrame([("a", D(2023, m, 1)) for m in range(1, 6)], "mo string, period date")
    table = spark.createDataFrame([(D(2023, 1, 1), 1.0), (D(2023, 3, 1), 3.0)], "period date, v double")
    got = {r.period.month: r.v for r in joins.attach(panel, table, ["period"], lag=1).collect()}
    assert got == {1: None, 2: 1.0, 3: None, 4: 3.0, 5: None}


def test_duplicate_build_side_is_an_error(spark):
    table = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    with pytest.raises(ValueError, match="duplicate key"):
        assert_unique(table, ["k"])
    with pytest.raises(ValueError, match="odd"):
        assert_none(table, F.col("v") == 2, "odd")


def test_region_join_keeps_the_last_and_tells_matches(spark):
    target = spark.createDataFrame([("x", "r1"), ("y", "r2")], "mo string, key string")
    macro = spark.createDataFrame([("r1", 1.0, 0), ("r1", 2.0, 1)], "key string, wage double, line int")
    got = {r.mo: (r.wage, r.regional_match) for r in joins.attach_region(target, macro, "key", "line", ["wage"]).collect()}
    assert got == {"x": (2.0, True), "y": (None, False)}


def test_crosswalk_statuses(spark):
    cross = spark.createDataFrame([("1", "A", "R", "i1"), ("2", "B", "R", "i2"), ("2", "C", "R", "i3"), (None, "D", "R", "i4")], "code string, name string, region string, id string")
    names = spark.createDataFrame([("1", "x", "R"), (None, "B", "R"), ("2", "zz", "R"), (None, "new", "R")], "code string, name string, region string")
    got = {(r.code, r.name): (r.id, r.status, r.confidence) for r in joins.resolve(names, cross).collect()}
    assert got == {("1", "x"): ("i1", "exact", 1.0), (None, "B"): ("i2", "crosswalk", 0.95), ("2", "zz"): ("R::zz", "ambiguous", 0.2), (None, "new"): ("R::new", "inferred", 0.55)}


def test_cold_entities_get_the_median_before(spark):
    history = spark.createDataFrame([("a", D(2023, 1, 1), 10.0), ("a", D(2023, 2, 1), -1.0), ("b", D(2023, 1, 1), 20.0), ("b", D(2023, 5, 1), 999.0)], "mo string, period date, y double")
    asked = spark.createDataFrame([("a", D(2023, 3, 1)), ("new", D(2023, 3, 1)), ("new", D(2022, 1, 1))], "mo string, period date")
    got = {(r.mo, r.period): (r.filled, r.fill_source) for r in joins.last_positive_before(history, asked).collect()}
    assert got == {("a", D(2023, 3, 1)): (10.0, "history"), ("new", D(2023, 3, 1)): (15.0, "median"), ("new", D(2022, 1, 1)): (None, None)}


def test_newcomers_get_the_median_of_positive_values(spark, months):
    history = spark.createDataFrame([("a", p, v) for p, v in zip(months(2020, 1, 4), [0.0, -5.0, 10.0, 40.0])] + [("a", D(2020, 6, 1), None)], "mo string, period date, y double")
    asked = spark.createDataFrame([("b", p) for p in months(2020, 2, 5)] + [("a", D(2020, 4, 1)), ("b", None)], "mo string, period date")
    got = {(r.mo, r.period): (r.filled, r.fill_source) for r in joins.last_positive_before(history, asked).collect()}
    assert got["b", D(2020, 3, 1)] == (None, None) and got["b", D(2020, 4, 1)] == (10.0, "median") and got["b", D(2020, 6, 1)] == (25.0, "median")
    assert got["a", D(2020, 4, 1)] == (10.0, "history") and got["b", None] == (None, None)
    plan = joins.last_positive_before(history, asked)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert joins.last_positive_before(history, asked.limit(0)).count() == 0
