from __future__ import annotations

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from monthgrid.operators import blend, folds, forecast, impute, metrics, news, order, submit

D = datetime.date


def test_metrics_and_undefined_r2(spark):
    rows = spark.createDataFrame([(0, "m", 10.0, 9.0), (0, "m", 20.0, 22.0), (1, "m", 5.0, 5.0)], "fold int, model string, target double, pred double")
    got = {r.fold: r for r in metrics.pooled(rows, ["model"]).collect()}
    assert got["0"].mae == 1.5 and got["0"].wape == pytest.approx(0.1) and got["0"].r2 == pytest.approx(1 - 5 / 50)
    assert got["1"].r2 is None and got["pooled"].n == 3 and got["pooled"].mae == 1.0


def test_complete_leads(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3)], "mo string, lead_months int")
    assert {(r.mo, r.lead_months) for r in metrics.complete_leads(rows, 3, ["mo"]).collect()} == {("a", 1), ("a", 2), ("a", 3)}
    assert metrics.complete_leads(rows, 6, ["mo"]).count() == 0


def test_constant_sides_have_no_correlation(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (None, 1.0)], "x double, y double")
    r = metrics.correlations(rows, "x", "y").first()
    assert (r.n, r.pearson, r.spearman) == (2, 0.0, 0.0)


def test_folds_purge_targets_that_reach_the_test(spark):
    days = [D(2023, 1, k) for k in range(1, 19)]
    rows = spark.createDataFrame([(m, d, d + datetime.timedelta(days=2)) for m in ("a", "b") for d in days], "mo string, origin date, target_end date")
    table = folds.fold_table(rows, 3, 2, 1, 6)
    got = folds.assign(rows, table).collect()
    for k in range(3):
        train, test = [r for r in got if r.fold == k and r.role == "train"], [r for r in got if r.fold == k and r.role == "test"]
        assert len(test) == 4 and max(r.target_end for r in train) <= min(r.origin for r in test)
        assert not {r.origin for r in train} & {r.origin for r in test}
    sizes = [sum(r.fold == k and r.role == "train" for r in got) for k in range(3)]
    assert sizes == sorted(sizes) and len(set(sizes)) == 3
    assert folds.fold_table(rows, 3, 2, 1, 100).count() == 0


def test_panel_contract(spark):
    ok = [("a", D(2023, 1, 1), D(2023, 2, 1), 1, 5.0, datetime.datetime(2022, 12, 31))]
    kind = "mo string, origin date, target_end date, lead_months int, target double, available_at timestamp"
    assert folds.check_panel(spark.createDataFrame(ok, kind), ["mo", "origin"]).count() == 1
    for k, bad in ((2, D(2023, 3, 1)), (4, None), (4, float("inf")), (5, datetime.datetime(2023, 1, 1))):
        row = list(ok[0])
        row[k] = bad
        with pytest.raises(ValueError):
            folds.check_panel(spark.createDataFrame([tuple(row)], kind), ["mo", "origin"])


def test_alert_raises_the_boosting_weight(spark):
    kind = "lead_months int, gate_alert boolean, pred_trend double, pred_boost double, pred_foundation double"
    rows = spark.createDataFrame([(1, False, 10.0, 20.0, 30.0), (1, True, 10.0, 20.0, 30.0), (6, True, 10.0, 20.0, 30.0), (9, None, 10.0, 20.0, 30.0), (2, False, -1.0, -1.0, -1.0)], kind)
    got = [(round(r.w_trend, 4), round(r.w_boost, 4), round(r.w_foundation, 4), r.pred_blend) for r in blend.regime_blend(rows).collect()]
    assert got[0][:3] == (0.563, 0.437, 0.0) and got[1][:3] == (0.225, 0.7, 0.075) and got[2][:3] == (0.15, 0.8, 0.05)
    assert got[3][:3] == (0.2, 0.75, 0.05) and got[4][3] == pytest.approx(1e-6)
    assert blend.two_arm_gate(rows).collect()[1].pred_gated == 20.0


def test_weight_fit_finds_the_better_arm(spark):
    rows = spark.createDataFrame([(float(v), float(v), v * 3.0, 0.0, 1) for v in range(1, 9)], "target double, pred_boost double, pred_foundation double, pred_trend double, lead_months int")
    r = blend.fit_two_arms(rows).first()
    assert (r.w_boost, r.mae) == (1.0, 0.0)
    s = blend.fit_simplex(rows).first()
    assert s.mae == 0.0 and s.w_boost == pytest.approx(1.0)


def test_district_median_comes_from_training_rows(spark):
    kind = "period date, mo string, fd string, wage double"
    train = spark.createDataFrame([(D(2023, 1, 1), "a", "x", 10.0), (D(2023, 1, 1), "b", "x", 20.0)], kind)
    test = spark.createDataFrame([(D(2023, 2, 1), "a", "x", None), (D(2023, 2, 1), "c", "z", None), (D(2023, 2, 1), "b", "x", 7.0)], kind)
    got = {r.mo: (r.wage, r.wage_source) for r in impute.district_median(test, train, "wage", "fd").collect()}
    assert got == {"a": (15.0, "federal_district"), "c": (15.0, "global"), "b": (7.0, "region")}


def test_empty_column_is_filled_with_zero(spark):
    rows = spark.createDataFrame([(None, True), (None, False)], "v double, train boolean")
    assert [r.v for r in impute.fold_median(rows, ["v"], F.col("train")).collect()] == [0.0, 0.0]


def test_wage_growth(spark, months):
    rows = spark.createDataFrame([("a", p, 10.0, float(k + 1), 0.0) for k, p in enumerate(months(2022, 1, 13))], "mo string, period date, y double, wage double, employment double")
    last = impute.normalised_ratios(rows).orderBy(F.desc("period")).first()
    assert last.wage_growth_yoy == pytest.approx(12.0) and last.y_per_employed is None


def test_grid_is_filled_and_checked(spark, months):
    roster = spark.createDataFrame([("a",), ("b",)], "mo string")
    dates = spark.createDataFrame([(p,) for p in months(2024, 7, 6)], "period date")
    preds = spark.createDataFrame([(m, p, v) for m, k in (("a", 10.0), ("b", 20.0)) for p, v in ((D(2024, 7, 1), k), (D(2024, 12, 1), k + 2))], "mo string, period date, pred double")
    got = submit.assemble(roster, dates, preds, fill=True).collect()
    assert len(got) == 12 and [r.pred for r in got[:6]] == [10.0] * 5 + [12.0]
    with pytest.raises(ValueError, match="missing"):
        submit.assemble(roster, dates, preds)
    with pytest.raises(ValueError, match="roster"):
        submit.assemble(roster.filter("mo = 'a'"), dates, preds, fill=True)
    with pytest.raises(ValueError, match="duplicate"):
        submit.assemble(roster, dates, preds.union(preds), fill=True)


def test_trend_follows_a_line_and_falls_back(spark, months):
    rows = [("a", p, 5.0 + 2 * k) for k, p in enumerate(months(2022, 1, 24))] + [("b", p, 7.0) for p in months(2022, 1, 2)]
    history = spark.createDataFrame(rows, "mo string, period date, y double")
    future = spark.createDataFrame([(m, p) for m in ("a", "b", "c") for p in months(2024, 1, 2)], "mo string, period date")
    got = {(r.mo, r.period): r for r in forecast.trend_arm(history, future, most_fallbacks=1).collect()}
    assert got["a", D(2024, 1, 1)].pred == pytest.approx(53, rel=0.03) and got["a", D(2024, 1, 1)].mode == "fit"
    assert got["b", D(2024, 1, 1)].pred == 7.0 and got["b", D(2024, 1, 1)].mode == "fallback_last_value"
    assert got["c", D(2024, 1, 1)].pred == 0.0
    with pytest.raises(ValueError, match="fell back"):
        forecast.trend_arm(history, future)


def test_recursive_path_ignores_what_follows(spark, months):
    rows = [("a", p, v) for p, v in zip(months(2023, 1, 6), [10.0, 20.0, 30.0, 999.0, 999.0, 999.0])]
    history = spark.createDataFrame(rows, "mo string, period date, y double")
    got = forecast.recursive_arm(history, "2023-03-01", 2, lambda f: f["y_lag_1"] + 1).orderBy("lead_months").collect()
    assert [r.pred for r in got] == [31.0, 32.0] and got[0].period == D(2023, 4, 1)


def test_last_value_arm(spark, months):
    history = spark.createDataFrame([("a", p, v) for p, v in zip(months(2023, 1, 3), [1.0, 2.0, float("nan")])], "mo string, period date, y double")
    asked = spark.createDataFrame([("a",), ("b",)], "mo string")
    assert {r.mo: r.pred for r in submit.last_value_arm(history, asked).collect()} == {"a": 2.0, "b": 0.0}


def test_news_months_and_shock(spark, months):
    counts = [1, 2, 3, 4, 0, 2]
    rows = [(p, 0.5) for p, n in zip(months(2023, 1, 6), counts) for _ in range(n)]
    got = news.shock(news.monthly(spark.createDataFrame(rows, "period date, score double"))).orderBy("period").collect()
    assert [r.news_volume for r in got] == counts and got[4].sentiment_index is None
    assert got[3].news_shock_score == 2.0 and got[2].news_shock_score is None and got[2].news_shock_index == 0.0


def test_dedup_judges_each_key_on_all_records(spark):
    kind = "date date, seq int, source string, article_id string, url string, text string"
    rows = [(D(2023, 1, 1), 1, "s", "1", "u1", "body one"), (D(2023, 1, 2), 2, "s", "1", "u2", "body two"), (D(2023, 1, 3), 3, "s", "2", "u2", "body three"), (D(2023, 1, 4), 4, "s", "", "", "Body  ONE "), (D(2023, 1, 5), 5, "s", "", "", "fresh")]
    assert {r.seq for r in news.dedup(spark.createDataFrame(rows, kind)).collect()} == {1, 5}


def test_every_distinct_text_is_scored_once(spark):
    rows = spark.createDataFrame([(1, "growth growth"), (2, "growth growth"), (3, "crisis"), (4, None), (4, "crisis")], "i int, text string")
    seen = spark.sparkContext.accumulator(0)

    def scorer(df):
        @F.udf("double")
        def length(t):
            seen.add(1)
            return float(len(t))
        return df.withColumn("score", length("text"))

    got = news.scored(rows, scorer).collect()
    assert sorted((r.i, r.score or -1) for r in got) == [(1, 13.0), (2, 13.0), (3, 6.0), (4, -1), (4, 6.0)] and seen.value == 2


def test_scores_are_those_of_the_learnt_weights(spark):
    import re

    from pyspark.ml.feature import HashingTF

    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(80)]
    made = []
    for k in range(400):
        junk = k % 3 == 0
        made.append((k, " ".join(w + ("%%" if junk and rng.random() < 0.5 else "") for w in rng.choice(words, 30)), 0 if junk else 1))
    df = spark.createDataFrame(made, "i int, text string, quality int")
    model = news.fit_scorer(df.filter("i < 300"), "text", "quality", bits=10)
    got = {r.i: r.score for r in news.scored(df, model).collect()}
    held = [(got[i], q) for i, _, q in made if i >= 300]
    assert np.mean([(s > 0.5) == q for s, q in held]) > 0.97
    tf, weights = HashingTF(numFeatures=1 << 10), model.stages[-1]
    for i, text, _ in made[300:310]:
        terms = re.findall(r"[^\W_]+|[^\s\w]+|_+", text.lower())
        pairs = [f"{a} {b}" for a, b in zip(terms, terms[1:])]
        x = []
        for items in (terms, pairs):
            v = np.zeros(1 << 10)
            for t in items:
                v[tf.indexOf(t)] += 1
            x.append(v / np.linalg.norm(v))
        z = float(np.concatenate(x) @ weights.coefficients.toArray()) + weights.intercept
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
    assert news.scored(df.withColumn("text", F.lit("")), model).filter("score is null").count() == 0


@pytest.mark.parametrize("small", [0, 200_000])
def test_quantiles_and_ranks_are_exact_in_bins(spark, small):
    rng = np.random.default_rng(5)
    rows = [("a", float(v)) for v in np.concatenate([rng.normal(0, 1e4, 700), np.full(400, 3.5), [1e12, -1e12]])]
    rows += [("b", 2.0), (None, 1.0), (None, 4.0), ("c", None), ("d", float("nan"))]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: list(r.q) for r in order.quantiles(df, "v", [0.0, 0.1, 0.5, 0.93, 1.0], ["k"], small=small).collect()}
    for k in ("a", "b", None):
        assert got[k] == pytest.approx(list(np.quantile([v for x, v in rows if x == k], [0.0, 0.1, 0.5, 0.93, 1.0])), rel=1e-12)
    assert set(got) == {"a", "b", None}
    values = pd.Series([v for x, v in rows if x == "a"])
    want = dict(zip(values, values.rank()))
    assert {r.value: r.rank for r in order.ranked(df.filter("k = 'a'"), "v").collect()} == want
    assert [r.q for r in order.quantiles(df.filter("k = 'c'"), "v", [0.5], small=small).collect()] in ([], [None])
