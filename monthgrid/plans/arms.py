"""Queries of the forecast arms.  Fits of trees and trends have no twin in SQL; they are held against Python in the tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.operators import folds, forecast, joins, windows
from monthgrid.operators.panel import direct
from monthgrid.operators.windows import by
from monthgrid.plans.book import OBSERVED, PANEL, register, sql
from monthgrid.plans.joining import macro
from monthgrid.plans.panels import observed, panel, r

BOOK: dict = {}
#: What the trees see: the panel's causal features, the calendar, and the market's discount of the month before.
COLUMNS = [
    "y_lag_1", "y_lag_2", "y_lag_3", "y_lag_12", "y_growth_mom", "y_growth_yoy", "y_mean_3", "y_std_3", "y_min_3", "y_max_3", "y_mean_12", "y_std_12", "y_min_12", "y_max_12",
    "spending_volatility", "month", "quarter", "year", "discount",
]
ORIGIN, STEPS, TREES, DEPTH = "2000-09-01", 12, 12, 4


def featured(spark, sf) -> DataFrame:
    """(mo, period, y) with COLUMNS: all are known before the month."""
    rows = joins.attach(windows.features(panel(spark, sf)), macro(spark, sf), ["period"], lag=1)
    return rows.withColumns({"month": F.month("period"), "quarter": F.quarter("period"), "year": F.year("period")})


@register(BOOK, "ts13_trend_arm")
def ts13(spark, sf):
    rows = observed(spark, sf)
    return r(forecast.trend_arm(rows.filter(F.col("period") < "2001-01-01"), rows.filter(F.col("period") >= "2001-01-01")), pred=2)


@register(BOOK, "ts14_boosting_arm")
def ts14(spark, sf):
    """One step ahead: trained on the months before ORIGIN, asked for all from it on."""
    rows = featured(spark, sf)
    out = forecast.boosting_arm(rows.filter(F.col("period") < ORIGIN).withColumn("target", F.col("y")), rows.filter(F.col("period") >= ORIGIN), COLUMNS, trees=TREES, depth=DEPTH)
    return r(out.select("mo", "period", "y", "pred", "model"), pred=2)


SPLIT = PANEL + """, d AS (SELECT a.mo, a.period AS origin, a.y AS now, a.y12 AS year_ago, b.y AS target, CAST(b.period AS DATE) AS target_end FROM (SELECT *, lag(y, 12) OVER (PARTITION BY mo ORDER BY period) AS y12 FROM panel) a JOIN panel b ON a.mo = b.mo AND b.period = a.period + INTERVAL 3 MONTH WHERE b.y IS NOT NULL),
o AS (SELECT origin, row_number() OVER (ORDER BY origin) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT origin FROM d)),
fo AS (SELECT CAST(k AS INTEGER) AS fold, min(origin) FILTER (i < n - 6 + k * 2 - 3) AS train_start, max(origin) FILTER (i < n - 6 + k * 2 - 3) AS train_end, min(origin) FILTER (i BETWEEN n - 6 + k * 2 AND n - 6 + k * 2 + 1) AS test_start, max(origin) FILTER (i BETWEEN n - 6 + k * 2 AND n - 6 + k * 2 + 1) AS test_end FROM o, (SELECT unnest(range(3)) AS k) GROUP BY k),
split AS (SELECT d.*, fold, CASE WHEN origin BETWEEN test_start AND test_end THEN 'test' ELSE 'train' END AS role FROM d, fo WHERE (origin BETWEEN test_start AND test_end) OR (origin BETWEEN train_start AND train_end AND target_end <= test_start))"""


def supervised(spark, sf) -> DataFrame:
    """Rows three months ahead in three folds, purged by the end of their target."""
    w = by()
    rows = panel(spark, sf).select("mo", "period", "y", F.col("y").alias("now"), F.lag("y", 12).over(w).alias("year_ago"))
    made = direct(rows, 3).select("mo", "origin", "target", "target_end", "now", "year_ago")
    return folds.assign(made, folds.fold_table(made, gap=3, target_end="target_end"))


@register(BOOK, "ts21_cross_validation", sql(SPLIT, """, m AS (SELECT fold, quantile_cont(now, 0.5) AS m FROM split WHERE role = 'train' GROUP BY fold),
x AS (SELECT split.*, coalesce(now, m) AS v FROM split JOIN m USING (fold)),
b AS (SELECT fold, regr_slope(target, v) AS b1, regr_intercept(target, v) AS b0, count(*) AS n_train FROM x WHERE role = 'train' GROUP BY fold),
p AS (SELECT CAST(fold AS VARCHAR) AS fold, target, b0 + b1 * v AS pred, n_train FROM x JOIN b USING (fold) WHERE role = 'test')
SELECT fold, max(n_train) AS n_train, count(*) AS n_test, round(avg(abs(target - pred)), 2) AS mae, round(1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*)), 6) AS r2 FROM p GROUP BY fold
UNION ALL SELECT 'pooled', NULL, count(*), round(avg(abs(target - pred)), 2), round(1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*)), 6) FROM p""").replace("\n, m", ", m"))
def ts21(spark, sf):
    """A line on the last known value, by fold and pooled."""
    from pyspark.ml.regression import LinearRegression

    rows = forecast.materialized(supervised(spark, sf), "folds")
    done = forecast.validate(rows, LinearRegression(solver="normal"), ["now"])
    return r(forecast.fold_scores(rows, done), mae=2, r2=6)


@register(BOOK, "ts21_scaled_elastic_net")
def ts21b(spark, sf):
    """Any regressor goes through the same pipeline: an elastic net over scaled features of two columns."""
    from pyspark.ml.regression import LinearRegression

    rows = forecast.materialized(supervised(spark, sf), "folds")
    done = forecast.validate(rows, LinearRegression(regParam=0.1, elasticNetParam=0.5), ["now", "year_ago"], scale=True)
    return r(forecast.fold_scores(rows, done), mae=2, r2=6)


ASKED = OBSERVED + """, a AS (SELECT mo, period AS origin FROM obs WHERE period >= DATE '2001-01-01'),
c AS (SELECT a.mo, a.origin, o.y, row_number() OVER (PARTITION BY a.mo, a.origin ORDER BY o.period DESC) AS back, count(*) OVER (PARTITION BY a.mo, a.origin) AS n FROM a JOIN obs o ON o.mo = a.mo AND o.period < a.origin)"""


def asked(spark, sf):
    rows = observed(spark, sf)
    return rows, rows.filter(F.col("period") >= "2001-01-01").select("mo", F.col("period").alias("origin"))


@register(BOOK, "ts15_ts16_foundation_adapter", sql(ASKED, "SELECT a.mo, a.origin, coalesce(c.y, 0.0) AS pred, 'fallback_last_value' AS mode FROM a LEFT JOIN c ON c.mo = a.mo AND c.origin = a.origin AND c.back = 1"))
def ts15(spark, sf):
    """Without a pretrained model the arm gives the last value, and says so."""
    return forecast.foundation_arm(*asked(spark, sf), 3)


def year_before(device: str):
    """A model in the adapter's form, for want of a pretrained one: each month as in the last year of its context."""
    return lambda x, steps: np.tile(x[:, -12:], -(-steps // 12))[:, :steps] if x.shape[1] >= 12 else np.repeat(x[:, -1:], steps, axis=1)


@register(BOOK, "ts15_seasonal_contexts", sql(ASKED, "SELECT mo, origin, CASE WHEN n >= 12 THEN max(y) FILTER (back = 12 - 3) ELSE max(y) FILTER (back = 1) END AS pred, CASE WHEN n > 1 THEN 'cpu' ELSE 'fallback_last_value' END AS mode FROM c GROUP BY mo, origin, n"))
def ts15b(spark, sf):
    """Contexts of up to 24 values through the adapter, in batches, to a model of one array call: the fourth step of each."""
    return forecast.foundation_arm(*asked(spark, sf), 3, year_before, context=24)


@register(BOOK, "ts17_recursive_path")
def ts17(spark, sf):
    """A year month by month on own predictions, by trees fitted on the months before; the discount stays as last known."""
    rows = featured(spark, sf)
    train = rows.filter(F.col("period") < ORIGIN)
    model = forecast.boosting_model(train.withColumn("target", F.col("y")), COLUMNS, trees=TREES, depth=DEPTH)
    entities = observed(spark, sf).select("mo").distinct()
    last = macro(spark, sf).filter(F.col("period") < ORIGIN).agg(F.max_by("discount", "period").alias("discount"))
    frozen = entities.crossJoin(F.broadcast(last))
    return r(forecast.recursive_model(observed(spark, sf), ORIGIN, STEPS, model, entities=entities, frozen=frozen), pred=2)
