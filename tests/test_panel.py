"""The panel, its windows, and that nothing looks ahead."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from monthgrid.operators import windows as wn
from monthgrid.operators.panel import calendar, direct, regularize

D = datetime.date


@pytest.fixture()
def two(spark, months):
    rows = [("a", p, float(k + 1)) for k, p in enumerate(months(2022, 1, 30))] + [("b", p, 100.0 * (k + 1)) for k, p in enumerate(months(2022, 1, 30))]
    return spark.createDataFrame(rows, "mo string, period date, y double")


def first(df, mo="a"):
    return df.filter(F.col("mo") == mo).orderBy("period").first()


def test_known_values(two):
    rows = wn.features(regularize(two)).cache()
    a = first(rows)
    assert (a.period, a.y, a.y_lag_1, a.y_lag_12) == (D(2023, 1, 1), 13.0, 12.0, 1.0)
    assert (a.y_mean_3, a.y_std_3, a.y_min_12, a.y_max_12, a.y_growth_yoy) == (11.0, 1.0, 1.0, 12.0, None)
    following = rows.filter("mo = 'a' and period = '2023-02-01'").first()
    assert following.y_growth_yoy == pytest.approx(12.0)
    assert first(rows, "b").y_lag_1 == 1200.0


def test_a_changed_future_changes_nothing_before(two):
    cut = "2023-06-01"
    changed = two.withColumn("y", F.when(F.col("period") >= cut, F.lit(1e12)).otherwise(F.col("y")))
    before = lambda df: df.filter(F.col("period") < cut).drop("y").orderBy("mo", "period").collect()
    assert before(wn.features(regularize(two))) == before(wn.features(regularize(changed)))
    at = lambda df: df.filter(F.col("period") == cut).drop("y").orderBy("mo").collect()
    assert at(wn.features(regularize(two))) == at(wn.features(regularize(changed)))


def test_a_missing_month_is_not_the_row_before(two):
    rows = wn.features(regularize(two.filter("not (mo = 'a' and period = '2023-02-01')")))
    r = rows.filter("mo = 'a' and period = '2023-03-01'").first()
    assert (r.y_lag_1, r.y_lag_2, r.y_mean_3) == (None, 13.0, None)


def test_zero_denominator_is_null(two):
    zero = two.withColumn("y", F.when((F.col("mo") == "a") & (F.col("period") == "2022-12-01"), F.lit(0.0)).otherwise(F.col("y")))
    r = wn.features(regularize(zero)).filter("mo = 'a' and period = '2023-02-01'").first()
    assert r.y_growth_mom is None


def test_regularize_and_calendar_agree(two):
    gappy = two.filter(F.month("period") % 3 != 0)
    full = regularize(gappy)
    assert full.select("mo", "period").exceptAll(calendar(gappy)).count() == 0
    assert full.count() == calendar(gappy).count() and full.filter("y is not null").count() == gappy.count()


def test_regularize_empty_and_single(spark, two):
    assert regularize(two.limit(0)).count() == 0
    one = regularize(two.filter("mo = 'a'").limit(1)).collect()
    assert len(one) == 1 and one[0].y == 1.0


def test_direct_panel_target(two):
    r = direct(regularize(two), 3).filter("mo = 'a'").orderBy("origin").first()
    assert (r.origin, r.target, r.target_end) == (D(2022, 1, 1), 4.0, D(2022, 4, 1))
    assert r.available_at < datetime.datetime(2022, 1, 1)


def test_quantile_fill_runs(two):
    w = wn.by()
    rows = regularize(two.filter("mo = 'a' and month(period) not in (4, 5, 6)")).select("*", wn.filled("y", w, 2).alias("f"), wn.run_of("period", w).alias("g"), wn.quantile("y", 0.5, wn.past(w, 3)).alias("q"))
    got = {r.period: r for r in rows.collect()}
    assert got[D(2022, 5, 1)].f == 3.0 and got[D(2022, 6, 1)].f is None
    assert got[D(2022, 4, 1)].q == 2.0
