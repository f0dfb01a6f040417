"""Forecast arms, blending and the selections under them, against plain Python."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthgrid.operators import blend, forecast, impute, joins, order

SERIES = "mo string, period date, y double"


# order statistics


def test_weighted_medians(spark):
    rng = random.Random(1)
    rows = [(k, float(rng.randrange(40)), rng.choice([0.0, 0.5, 1.0, 2.5])) for k in "ab" for _ in range(300)]
    rows += [("a", None, 1.0), ("a", float("nan"), 9.0), ("a", 1.0, None), ("b", 3.0, -1.0), ("c", 7.0, 1.0), ("d", 1.0, 0.0)]

    def plain(points):
        points = sorted((v, w) for v, w in points if v is not None and v == v and w and w > 0)
        half, total = sum(w for _, w in points) / 2, 0.0
        for v, w in points:
            total += w
            if total >= half:
                return v

    df = spark.createDataFrame(rows, "k string, v double, w double")
    got = {r.k: r.median for r in order.weighted_median(df, "v", "w", ["k"]).collect()}
    assert got == {k: plain([r[1:] for r in rows if r[0] == k]) for k in "abc"}
    assert order.weighted_median(df, "v", "w").first().median == plain([r[1:] for r in rows])
    assert order.weighted_median(df.limit(0), "v", "w").first().median is None


def test_medians_before_each_place(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(30), float(rng.choice([rng.randrange(9), rng.random() * 9]))) for _ in range(1500)] + [(3, 5.0)] * 700
    counts = spark.createDataFrame(rows, "at int, v double").groupBy("at", "v").count()
    places = [0, 1, 5, 17, 29, 30, 99]
    got = {r["at"]: r["median"] for r in order.prefix_medians(counts, "at", "v", "count", places).collect()}
    want = {p: float(np.median([v for a, v in rows if a < p])) for p in places if any(a < p for a, _ in rows)}
    assert got == pytest.approx(want)
    assert order.prefix_medians(counts, "at", "v", "count", []).count() == 0


def test_rows_looked_at_grow_with_the_history(spark):
    """What a place's median looks at is a bin or two, not all that is before it."""
    n, places = 20_000, list(range(1, 41))
    counts = spark.range(n).select((F.col("id") % 40).cast("int").alias("at"), (F.xxhash64("id") / 1e12).alias("v"), F.lit(1).alias("n")).cache()
    edges, _ = order.spread(counts.select(F.col("v").alias("value")), "value", [])
    largest = counts.crossJoin(edges).select(order.bin_of(F.col("v"), F.col("edges")).alias("b")).groupBy("b").count().agg(F.max("count")).first()[0]
    assert 2 * len(places) * largest < n
    got = {r["at"]: r["median"] for r in order.prefix_medians(counts, "at", "v", "n", places).collect()}
    rows = counts.select("at", "v").toPandas()
    assert got == pytest.approx({p: rows.v[rows["at"] < p].median() for p in places})


def test_many_columns_at_once(spark):
    rng = np.random.default_rng(3)
    rows = [(k % 2 == 0, *(None if rng.random() < 0.3 else float(x) for x in rng.normal(size=4)), None) for k in range(200)]
    names = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame(rows, "train boolean, " + ", ".join(f"{n} double" for n in names))
    filled = impute.fold_median(df, names, F.col("train")).toPandas()
    for k, name in enumerate(names):
        known = [r[k + 1] for r in rows if r[0] and r[k + 1] is not None]
        want = [r[k + 1] if r[k + 1] is not None else (np.median(known) if known else 0.0) for r in rows]
        assert sorted(filled[name]) == pytest.approx(sorted(want))
    tracker, jobs = spark.sparkContext.statusTracker(), []
    for columns in (names[:1], names):
        spark.sparkContext.setJobGroup(f"columns-{len(columns)}", "")
        impute.fold_median(df, columns, F.col("train")).collect()
        jobs.append(len(tracker.getJobIdsForGroup(f"columns-{len(columns)}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[1] <= jobs[0] + 1


def test_last_value_or_median_before(spark, months):
    line = months(2020, 1, 6)
    rows = [("a", line[0], 5.0), ("a", line[2], -1.0), ("b", line[1], 7.0), ("c", line[1], 9.0)]
    asked = spark.createDataFrame([("a", line[3]), ("new", line[0]), ("new", line[1]), ("new", line[5])], "mo string, period date")
    got = {(r.mo, r.period): (r.filled, r.fill_source) for r in joins.last_positive_before(spark.createDataFrame(rows, SERIES), asked).collect()}
    assert got == {("a", line[3]): (5.0, "history"), ("new", line[0]): (None, None), ("new", line[1]): (5.0, "median"), ("new", line[5]): (7.0, "median")}


# blending


def oof(spark, n=120, seed=4, lead=True):
    rng = np.random.default_rng(seed)
    y = rng.normal(100, 20, n)
    rows = [(float(t), *(float(t + rng.normal(0, s)) for s in (5, 7, 9)), 1 if k % 2 else 6) for k, t in enumerate(y)]
    return spark.createDataFrame(rows, "target double, pred_trend double, pred_boost double, pred_foundation double, lead_months int")


def test_two_arm_weight_is_the_minimum(spark):
    df = oof(spark)
    extra = spark.createDataFrame([(1e6, 0.0, None, 1.0, 1), (None, 1.0, 1.0, 1.0, 1), (1e6, 1.0, 1.0, float("nan"), 1)], df.schema)
    row = blend.fit_two_arms(df.unionByName(extra), low=0.0).first()
    p = df.toPandas()
    mae = lambda w: float(np.abs(p.target - (w * p.pred_boost + (1 - w) * p.pred_foundation)).mean())
    scan = min(mae(w) for w in np.linspace(0, 1, 20_001))
    assert row.mae == pytest.approx(mae(row.w_boost), abs=1e-9) and row.mae <= scan + 1e-9
    far = df.withColumn("pred_foundation", F.col("target") + 50)
    assert blend.fit_two_arms(far).first().w_boost >= 0.70
    one = df.withColumn("pred_foundation", F.col("pred_boost"))
    assert blend.fit_two_arms(one).first().w_boost == 0.82 and blend.fit_two_arms(df.limit(0)).first().w_boost == 0.82


def test_simplex_weights_are_the_minimum(spark):
    df = oof(spark, 60)
    found = {r.lead_months: r for r in blend.fit_simplex(df).collect()}
    for h, p in df.toPandas().groupby("lead_months"):
        t, x, z = (p.target - p.pred_foundation).to_numpy(), (p.pred_trend - p.pred_foundation).to_numpy(), (p.pred_boost - p.pred_foundation).to_numpy()
        points = [(0, 0), (1, 0), (0, 1)] + [(a, 0) for a in t / x] + [(0, b) for b in t / z] + [((t[i] - z[i]) / (x[i] - z[i]), 1 - (t[i] - z[i]) / (x[i] - z[i])) for i in range(len(t))]
        points += [tuple(np.linalg.solve([[x[i], z[i]], [x[j], z[j]]], [t[i], t[j]])) for i, j in itertools.combinations(range(len(t)), 2)]
        best = min(float(np.abs(t - a * x - b * z).mean()) for a, b in points if a >= 0 and b >= 0 and a + b <= 1)
        r = found[h]
        assert r.mae == pytest.approx(best, rel=1e-8) and 0 <= r.gap <= 1e-9 * r.mae
        assert r.w_trend + r.w_boost + r.w_foundation == pytest.approx(1) and min(r.w_trend, r.w_boost, r.w_foundation) >= 0
        assert r.mae == pytest.approx(float(np.abs(t - r.w_trend * x - r.w_boost * z).mean()))
    # A corner of the simplex, and no rows at all.
    sure = blend.fit_simplex(df.withColumn("pred_boost", F.col("target"))).first()
    assert sure.w_boost == pytest.approx(1) and sure.mae == pytest.approx(0, abs=1e-9)
    assert blend.fit_simplex(df.limit(0)).count() == 0


# the trend


@pytest.mark.parametrize("seed", range(4))
def test_trend_is_the_posterior_maximum(seed):
    rng = np.random.default_rng(seed)
    t = np.arange(36.0)
    y = 100 + 2 * t - 6 * np.clip(t - 14, 0, None) * (seed % 2) + rng.normal(0, 1 + 5 * (seed > 1), 36)
    fit = forecast.trend_fit(t, y)
    loss = lambda b, s: forecast.trend_loss(fit.matrix, fit.scaled, b, s, 5.0, 0.05, 0.5)
    assert fit.loss == pytest.approx(loss(fit.beta, fit.sigma))
    for _ in range(4000):
        step = rng.normal(size=4) * 10.0 ** rng.uniform(-6, -1)
        b = np.where(rng.random(4) < 0.2, 0.0, fit.beta + step)
        assert loss(b, fit.sigma * np.exp(rng.normal() * 10.0 ** rng.uniform(-5, -1))) >= fit.loss - 1e-9
    # The conditions of a minimum: no slope on level and slope, the Laplace prior's pull on the changes.
    slope = (fit.matrix.T @ (fit.matrix @ fit.beta - fit.scaled)) / fit.sigma**2
    assert np.abs(slope[:2] + fit.beta[:2] / 25).max() < 1e-6
    assert all(abs(s + np.sign(b) / 0.05) < 1e-6 if abs(b) > 1e-12 else abs(s) <= 1 / 0.05 + 1e-6 for s, b in zip(slope[2:], fit.beta[2:]))


def test_trend_arm_fits_once_and_falls_back(spark, months):
    rows = [("a", p, 10.0 + 2 * k) for k, p in enumerate(months(2020, 1, 24))] + [("b", months(2020, 1, 1)[0], 4.0)]
    ahead = [(m, p) for m in "abc" for p in months(2022, 1, 2)]
    history, future = spark.createDataFrame(rows, SERIES), spark.createDataFrame(ahead, "mo string, period date")
    got = {(r.mo, r.period.month): (r.pred, r.mode) for r in forecast.trend_arm(history, future, most_fallbacks=1).collect()}
    assert got[("a", 1)][0] == pytest.approx(58, abs=1.5) and got[("b", 2)] == (4.0, "fallback_last_value") and got[("c", 1)] == (0.0, "fallback_last_value")
    with pytest.raises(ValueError):
        forecast.trend_arm(history, future)


# trees, recursion and validation


def monthly(months, n=40):
    rng = np.random.default_rng(6)
    return [(m, p, float(base + 4 * (k % 12) + k + rng.normal())) for m, base in (("a", 50.0), ("b", 90.0), ("c", 20.0)) for k, p in enumerate(months(2019, 1, n))]


def test_recursion_equals_plain_recursion_on_the_same_trees(spark, months, tmp_path):
    from pyspark.ml import PipelineModel
    from pyspark.ml.linalg import Vectors

    from monthgrid.operators import windows

    rows = monthly(months)
    history = spark.createDataFrame(rows, SERIES)
    columns = ["y_lag_1", "y_lag_2", "y_lag_3", "y_lag_12", "y_growth_mom", "y_growth_yoy", "y_mean_3", "y_std_3", "y_min_12", "y_max_12", "y_std_12", "spending_volatility", "month", "rate"]
    train = windows.causal(history).withColumns({"month": F.month("period"), "rate": F.month("period") / 10.0, "target": F.col("y")}).filter(F.col("period") < "2022-01-01")
    model = forecast.boosting_model(train, columns, trees=4, depth=3)
    model.write().overwrite().save(str(tmp_path / "trees"))
    again = PipelineModel.load(str(tmp_path / "trees"))
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("new",)], "mo string")
    frozen = spark.createDataFrame([("a", 0.3), ("b", 1.2), ("new", None)], "mo string, rate double")
    got = {(r.mo, r.lead_months): r.pred for r in forecast.recursive_model(history, "2022-01-01", 14, again, entities=names, frozen=frozen).collect()}
    rewritten = history.withColumn("y", F.when(F.col("period") < "2022-01-01", F.col("y")).otherwise(1e9))
    assert got == {(r.mo, r.lead_months): r.pred for r in forecast.recursive_model(rewritten, "2022-01-01", 14, model, entities=names, frozen=frozen).collect()}

    medians = {c: float(np.median([v for r in train.select(c).collect() if (v := r[0]) is not None])) for c in columns}
    before = {m: [y for e, p, y in rows if e == m and p.year < 2022] for m in "abc"}
    before["new"] = [float(np.median([y for _, p, y in rows if p.year < 2022]))]
    for mo, past in before.items():
        for k in range(14):
            lag = lambda n: past[-n] if len(past) >= n else None  # noqa: E731, B023
            over = lambda f, n: f(past[-n:]) if len(past) >= n else None  # noqa: E731, B023
            grown = lambda a, b: a / b - 1 if a is not None and b else None
            x = {f"y_lag_{n}": lag(n) for n in (1, 2, 3, 12)} | {"y_growth_mom": grown(lag(1), lag(2)), "y_growth_yoy": grown(lag(1), lag(13))}
            sd = lambda v: float(np.std(v, ddof=1))
            x |= {"y_mean_3": over(np.mean, 3), "y_std_3": over(sd, 3), "y_std_12": over(sd, 12), "y_min_12": over(min, 12), "y_max_12": over(max, 12)}
            x |= {"spending_volatility": sd(past) / abs(np.mean(past)) if len(past) > 1 else None, "month": k % 12 + 1, "rate": {"a": 0.3, "b": 1.2}.get(mo)}
            v = [medians[c] if x[c] is None else float(x[c]) for c in columns]
            past.append(max(float(np.expm1(model.stages[2].predict(Vectors.dense(v)))), 1e-6))
            assert got[(mo, k + 1)] == pytest.approx(past[-1], rel=1e-6)


def test_validation_equals_least_squares(spark):
    from pyspark.ml.regression import LinearRegression

    rng = np.random.default_rng(8)
    rows = []
    for fold in range(2):
        for k in range(60):
            a, b = rng.normal(size=2)
            rows.append((fold, "train" if k < 45 else "test", float(3 * a - b + 0.1 * rng.normal()), None if k % 9 == 0 else float(a), float(b), None))
    panel = spark.createDataFrame(rows, "fold int, role string, target double, a double, b double, never double")
    for scale in (False, True):
        done = forecast.validate(panel, LinearRegression(solver="normal"), ["a", "b", "never"], scale=scale)
        scores = {r.fold: r for r in forecast.fold_scores(panel, done).collect()}
        every = []
        for fold in range(2):
            part = [r for r in rows if r[0] == fold]
            middle = np.median([r[3] for r in part if r[1] == "train" and r[3] is not None])
            x = lambda role: np.array([[1.0, middle if r[3] is None else r[3], r[4]] for r in part if r[1] == role])  # noqa: E731, B023
            y = lambda role: np.array([r[2] for r in part if r[1] == role])  # noqa: E731, B023
            pred = x("test") @ np.linalg.lstsq(x("train"), y("train"), rcond=None)[0]
            every += list(zip(y("test"), pred))
            s = scores[str(fold)]
            assert (s.n_train, s.n_test) == (45, 15) and s.mae == pytest.approx(np.abs(y("test") - pred).mean(), rel=1e-6)
            assert s.r2 == pytest.approx(1 - ((y("test") - pred) ** 2).sum() / ((y("test") - y("test").mean()) ** 2).sum(), rel=1e-6)
        t, p = np.array(every).T
        assert scores["pooled"].mae == pytest.approx(np.abs(t - p).mean(), rel=1e-6) and scores["pooled"].n_test == 30


def test_validation_stops_on_predictions_that_are_not_finite(spark):
    panel = spark.createDataFrame([(0, "train", 1.0), (0, "test", 2.0)], "fold int, role string, target double")
    with pytest.raises(ZeroDivisionError):
        forecast.cross_validate(panel, lambda train, test: 1 / 0)
