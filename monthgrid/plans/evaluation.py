"""Queries of metrics, folds, blending, imputation and the forecast grid."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthgrid.operators import blend, evidence, folds, impute, joins, metrics, submit
from monthgrid.plans import flows
from monthgrid.plans.book import ARMS, OBSERVED, PANEL, register, sql
from monthgrid.plans.joining import MACRO, arms, macro
from monthgrid.plans.panels import FEATURES, flagship, observed, panel, r
from monthgrid.session import table

BOOK: dict = {}
NAMES = ["pred_trend", "pred_boost", "pred_foundation"]
LONG = ARMS + """,
long AS (SELECT mo, period, fold, lead_months, target, 'pred_trend' AS model, pred_trend AS pred FROM oof UNION ALL SELECT mo, period, fold, lead_months, target, 'pred_boost', pred_boost FROM oof UNION ALL SELECT mo, period, fold, lead_months, target, 'pred_foundation', pred_foundation FROM oof)"""
SCORES = """count(*) AS n, round(avg(abs(target - pred)) + 0.00000013, 6) AS mae, round(sqrt(avg((target - pred) * (target - pred))), 6) AS rmse, round(sum(abs(target - pred)) / nullif(sum(abs(target)), 0), 6) AS wape,
 round(CASE WHEN count(*) >= 2 AND max(target) > min(target) THEN 1 - sum((target - pred) * (target - pred)) / (var_pop(target) * count(*)) END, 6) AS r2"""
DIGITS = {"mae": 6, "rmse": 6, "wape": 6, "r2": 6}


def shown(df):
    """Scores as the twins show them: the mean error is moved off the ties of binary fractions before it is rounded."""
    return r(df.withColumn("mae", F.col("mae") + 0.00000013), **{c: n for c, n in DIGITS.items() if c in df.columns})


def long(spark, sf):
    return metrics.long_form(arms(spark, sf), NAMES, ["mo", "period", "fold", "lead_months"])


@register(BOOK, "ag6_metrics_pooled", sql(LONG, f"SELECT CAST(fold AS VARCHAR) AS fold, lead_months, model, {SCORES} FROM long GROUP BY ALL UNION ALL SELECT 'pooled', lead_months, model, {SCORES} FROM long GROUP BY ALL"))
def ag6(spark, sf):
    return shown(metrics.pooled(long(spark, sf), ["lead_months", "model"]))


@register(BOOK, "ag7_complete_cumulative", "WITH o AS (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber BETWEEN 1 AND 3) SELECT DISTINCT l_orderkey, l_linenumber FROM o WHERE l_orderkey IN (SELECT l_orderkey FROM o GROUP BY l_orderkey HAVING count(DISTINCT l_linenumber) = 3)")
def ag7(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    return metrics.complete_leads(rows, 3, ["l_orderkey"], "l_linenumber").select("l_orderkey", "l_linenumber")


@register(BOOK, "ag8_improvement", sql(LONG, "SELECT fold, lead_months, model, mae, round((base - mae) / nullif(base, 0), 6) AS improvement FROM (SELECT *, max(CASE WHEN model = 'pred_trend' THEN mae END) OVER (PARTITION BY fold, lead_months) AS base FROM (SELECT fold, lead_months, model, round(avg(abs(target - pred)) + 0.00000013, 6) AS mae FROM long GROUP BY ALL))"))
def ag8(spark, sf):
    rows = shown(metrics.accuracy(long(spark, sf), ["fold", "lead_months", "model"]).select("fold", "lead_months", "model", "mae"))
    return r(metrics.improvement(rows, ["fold", "lead_months"], "pred_trend"), improvement=6)


@register(BOOK, "ag9_correlations", sql(ARMS, """, k AS (SELECT target, pred_boost, rank() OVER (ORDER BY target) + (count(*) OVER (PARTITION BY target) - 1) / 2.0 AS a, rank() OVER (ORDER BY pred_boost) + (count(*) OVER (PARTITION BY pred_boost) - 1) / 2.0 AS b FROM (SELECT target, round(pred_boost, 1) AS pred_boost FROM oof))
SELECT count(*) AS n, round(corr(target, pred_boost), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM k""".replace("\n", " ")).replace("\n, k", ", k"))
def ag9(spark, sf):
    rows = arms(spark, sf).withColumn("pred_boost", F.round("pred_boost", 1))
    return r(metrics.correlations(rows, "target", "pred_boost"), pearson=6, spearman=6)


FLAGS = OBSERVED + ", f AS (SELECT mo, period, y > avg(y) OVER (PARTITION BY mo) * 1.2 AS high, month(period) IN (1, 2, 3) AS winter, month(period) = 12 AS december FROM obs)"


def flags(spark, sf):
    from pyspark.sql import Window as W

    m = F.month("period")
    return observed(spark, sf).select("mo", "period", (F.col("y") > F.avg("y").over(W.partitionBy("mo")) * 1.2).alias("high"), m.isin(1, 2, 3).alias("winter"), (m == 12).alias("december"))


@register(BOOK, "ag10_jaccard_rows", sql(FLAGS, "SELECT mo, round(CASE WHEN count(*) FILTER (high OR winter) > 0 THEN count(*) FILTER (high AND winter) / count(*) FILTER (high OR winter) ELSE 1.0 END, 6) AS jaccard FROM f GROUP BY mo"))
def ag10(spark, sf):
    return flags(spark, sf).groupBy("mo").agg(F.round(metrics.jaccard_rows(F.col("high"), F.col("winter")), 6).alias("jaccard"))


@register(BOOK, "ag10_jaccard_sets", sql(FLAGS, """, s AS (SELECT DISTINCT method, period FROM (SELECT period, 'high' AS method FROM f WHERE high UNION ALL SELECT period, 'winter' FROM f WHERE winter UNION ALL SELECT period, 'december' FROM f WHERE december)),
n AS (SELECT method, count(*) AS n FROM s GROUP BY method)
SELECT a.method AS method_a, b.method AS method_b, round(coalesce(i, 0) / (a.n + b.n - coalesce(i, 0)), 6) AS jaccard FROM n a JOIN n b ON a.method < b.method LEFT JOIN (SELECT x.method AS ma, y.method AS mb, count(*) AS i FROM s x JOIN s y USING (period) GROUP BY ALL) ON ma = a.method AND mb = b.method""").replace("\n, s", ", s"))
def ag10b(spark, sf):
    rows = flags(spark, sf).unpivot(["period"], ["high", "winter", "december"], "method", "on").filter("on")
    return r(metrics.jaccard_sets(rows, "method", "period"), jaccard=6)


@register(BOOK, "ag11_detector_summary", sql(FLAGS, """, h AS (SELECT mo, (year(period) * 12 + month(period)) - lag(year(period) * 12 + month(period)) OVER (PARTITION BY mo ORDER BY period) AS gap FROM f WHERE high AND NOT december)
SELECT (SELECT count(*) FROM f WHERE high AND NOT december) AS shocks, (SELECT count(*) FROM f WHERE NOT december) AS eligible, (SELECT count(DISTINCT mo) FROM h) AS entities, (SELECT round(avg(gap), 6) FROM h) AS mean_gap, round((SELECT count(*) FROM f WHERE high AND NOT december) / (SELECT count(*) FROM f WHERE NOT december), 6) AS rate""").replace("\n, h", ", h"))
def ag11(spark, sf):
    rows = flags(spark, sf).withColumn("eligible", ~F.col("december"))
    return r(metrics.detector_summary(rows, "high", "eligible"), mean_gap=6, rate=6)


@register(BOOK, "ag16_quantiles", sql(OBSERVED, "SELECT round(q[1], 5) AS q0, round(q[2], 5) AS q25, round(q[3], 5) AS q50, round(q[4], 5) AS q75, round(q[5], 5) AS q100 FROM (SELECT quantile_cont(y, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM obs)"))
def ag16(spark, sf):
    return r(submit.quantiles(observed(spark, sf), "y"), q0=5, q25=5, q50=5, q75=5, q100=5)


GAPS = PANEL + """, g AS (SELECT p.mo, period, r_name AS district, CASE WHEN (month(period) + n_nationkey) % 4 = 0 THEN NULL ELSE y END AS wage, period < DATE '2000-01-01' AS train
 FROM panel p JOIN nation ON n_name = p.mo JOIN region ON n_regionkey = r_regionkey)"""


def gaps(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = panel(spark, sf).join(F.broadcast(n), F.col("mo") == F.col("n_name"))
    wage = F.when((F.month("period") + F.col("n_nationkey")) % 4 != 0, F.col("y"))
    return rows.select("mo", "period", F.col("r_name").alias("district"), wage.alias("wage"), (F.col("period") < "2000-01-01").alias("train"))


@register(BOOK, "ag14_fold_median", sql(GAPS, """, q AS (SELECT quantile_cont(wage, 0.5) AS a, quantile_cont(half, 0.5) AS b, quantile_cont(thin, 0.5) AS c FROM (SELECT *, wage / 2 AS half, CASE WHEN month(period) = 7 THEN wage END AS thin FROM g) WHERE train)
SELECT mo, period, round(coalesce(wage, a, 0.0), 5) AS wage, round(coalesce(wage / 2, b, 0.0), 5) AS half, round(coalesce(CASE WHEN month(period) = 7 THEN wage END, c, 0.0), 5) AS thin, 0.0 AS never FROM g, q""").replace("\n, q", ", q"))
def ag14(spark, sf):
    rows = gaps(spark, sf).withColumns({"half": F.col("wage") / 2, "thin": F.when(F.month("period") == 7, F.col("wage")), "never": F.lit(None).cast("double")})
    names = ["wage", "half", "thin", "never"]
    return r(impute.fold_median(rows, names, F.col("train")).select("mo", "period", *names), wage=5, half=5, thin=5)


@register(BOOK, "ag15_ts22_district_median", sql(GAPS, """, d AS (SELECT district, quantile_cont(wage, 0.5) AS dm FROM g WHERE train AND district <> 'ASIA' GROUP BY district), a AS (SELECT quantile_cont(wage, 0.5) AS gm FROM g WHERE train AND district <> 'ASIA'),
x AS (SELECT g.*, last_value(wage IGNORE NULLS) OVER (PARTITION BY mo ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS f FROM g)
SELECT mo, period, round(coalesce(wage, dm, f, gm), 5) AS wage, CASE WHEN wage IS NOT NULL THEN 'region' WHEN dm IS NOT NULL THEN 'federal_district' WHEN f IS NOT NULL THEN 'forward_fill' WHEN gm IS NOT NULL THEN 'global' END AS wage_source FROM x LEFT JOIN d USING (district), a""").replace("\n, d", ", d"))
def ag15(spark, sf):
    rows = gaps(spark, sf)
    out = impute.district_median(rows, rows.filter("train and district <> 'ASIA'"), "wage", "district")
    return r(out.select("mo", "period", "wage", "wage_source"), wage=5)


@register(BOOK, "ts22_scaling", sql(GAPS, "SELECT mo, period, round((wage - m) / CASE WHEN s > 0 THEN s ELSE 1 END, 6) AS standard, round((wage - q[2]) / CASE WHEN q[3] > q[1] THEN q[3] - q[1] ELSE 1 END, 6) AS robust FROM g, (SELECT avg(wage) AS m, stddev_pop(wage) AS s, quantile_cont(wage, [0.25, 0.5, 0.75]) AS q FROM g WHERE train)"))
def ts22(spark, sf):
    rows = gaps(spark, sf).select("mo", "period", F.col("wage").alias("standard"), F.col("wage").alias("robust"), "train")
    done = impute.scaled(impute.scaled(rows, ["standard"], F.col("train")), ["robust"], F.col("train"), robust=True)
    return r(done.drop("train"), standard=6, robust=6)


@register(BOOK, "wn13_fill_predictions", sql(GAPS, """, x AS (SELECT mo, period, CASE WHEN district = 'ASIA' THEN NULL ELSE wage END AS pred FROM g),
y AS (SELECT mo, period, coalesce(last_value(pred IGNORE NULLS) OVER (PARTITION BY mo ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(pred IGNORE NULLS) OVER (PARTITION BY mo ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM x),
m AS (SELECT period, quantile_cont(near, 0.5) AS pm FROM y GROUP BY period), a AS (SELECT quantile_cont(near, 0.5) AS am FROM y)
SELECT mo, y.period, round(coalesce(near, pm, am), 5) AS pred FROM y LEFT JOIN m ON y.period = m.period, a""").replace("\n, x", ", x"))
def wn13(spark, sf):
    rows = gaps(spark, sf).select("mo", "period", F.when(F.col("district") != "ASIA", F.col("wage")).alias("pred"))
    return r(impute.fill_predictions(rows), pred=5)


@register(BOOK, "ts33_normalised_ratios", sql(GAPS, "SELECT mo, period, round(CASE WHEN wage - 300000 > 0 THEN 1e6 / (wage - 300000) END, 6) AS y_per_wage, round(CASE WHEN month(period) > 3 THEN 1e6 / (month(period) - 3) END, 5) AS y_per_employed, round((wage - 300000) / nullif(lag(wage - 300000, 12) OVER (PARTITION BY mo ORDER BY period), 0) - 1, 4) AS wage_growth_yoy FROM g"))
def ts33(spark, sf):
    rows = gaps(spark, sf).select("mo", "period", F.lit(1e6).alias("y"), (F.col("wage") - 300000).alias("wage"), (F.month("period") - 3.0).alias("employment"))
    return r(impute.normalised_ratios(rows), y_per_wage=6, y_per_employed=5, wage_growth_yoy=4).select("mo", "period", "y_per_wage", "y_per_employed", "wage_growth_yoy")


FOLDS = PANEL + """, o AS (SELECT period AS origin, row_number() OVER (ORDER BY period) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT period FROM panel)),
fo AS (SELECT CAST(k AS INTEGER) AS fold, min(origin) FILTER (i < n - 6 + k * 2 - 1) AS train_start, max(origin) FILTER (i < n - 6 + k * 2 - 1) AS train_end, min(origin) FILTER (i BETWEEN n - 6 + k * 2 AND n - 6 + k * 2 + 1) AS test_start, max(origin) FILTER (i BETWEEN n - 6 + k * 2 AND n - 6 + k * 2 + 1) AS test_end FROM o, (SELECT unnest(range(3)) AS k) GROUP BY k)"""


@register(BOOK, "ts19_fold_table", sql(FOLDS, "SELECT fold, train_start, train_end, test_start, test_end FROM fo"))
def ts19(spark, sf):
    return folds.fold_table(panel(spark, sf), origin="period").drop("train_periods")


@register(BOOK, "ts19_purged_rows", sql(FOLDS, "SELECT mo, period AS origin, fold, CASE WHEN period BETWEEN test_start AND test_end THEN 'test' ELSE 'train' END AS role FROM panel, fo WHERE (period BETWEEN test_start AND test_end) OR (period BETWEEN train_start AND train_end AND period + INTERVAL 3 MONTH <= test_start)"))
def ts19b(spark, sf):
    rows = panel(spark, sf).select("mo", F.col("period").alias("origin"), F.add_months("period", 3).alias("target_end"))
    return folds.assign(rows, folds.fold_table(rows)).select("mo", "origin", "fold", "role")


PURGED = FOLDS + """, tr AS (SELECT k AS fold, count(*) FILTER (i < first - 1) AS n_train, count(*) FILTER (i < first - 1 AND origin + INTERVAL 3 MONTH <= test_start) AS n_left FROM (SELECT fo.fold AS k, fo.test_start, o.origin, o.i, o.n - 6 + fo.fold * 2 AS first FROM o, fo) GROUP BY k)"""


@register(BOOK, "ts19_purged_folds", sql(PURGED, "SELECT fo.fold, train_start, train_end, test_start, test_end, n_train AS train_periods FROM fo JOIN tr ON tr.fold = fo.fold WHERE n_train >= (SELECT max(n) FROM o) - 5 AND n_left >= (SELECT max(n) FROM o) - 5"))
def ts19c(spark, sf):
    """Targets of three months: a fold with enough training months, but for those whose targets reach into its test, is left out."""
    rows = panel(spark, sf).select("mo", F.col("period").alias("origin"), F.add_months("period", 3).alias("target_end"))
    n = rows.select("origin").distinct().count()
    return folds.fold_table(rows, min_train=n - 5, target_end="target_end")


@register(BOOK, "ts20_checked_panel", sql(PANEL, "SELECT a.mo, a.period AS origin, b.y AS target FROM panel a JOIN panel b ON a.mo = b.mo AND b.period = a.period + INTERVAL 1 MONTH WHERE b.y IS NOT NULL"))
def ts20(spark, sf):
    from monthgrid.operators.panel import direct

    rows = direct(panel(spark, sf), 1)
    return folds.check_panel(rows, ["mo", "origin"]).select("mo", "origin", "target")


def weights(arm: str, at: str = "lead_months", table: dict = blend.CALIBRATED) -> str:
    return f"CASE {at} " + " ".join(f"WHEN {h} THEN {w[arm]}" for h, w in table.items()) + " END"


BLEND = ARMS + f""", gated AS (SELECT *, coalesce(lag(target > 1.15 * pred_boost) OVER (PARTITION BY mo ORDER BY period), FALSE) AS gate_alert FROM oof),
wts AS (SELECT *, CASE WHEN gate_alert THEN greatest({weights('boost')}, CASE WHEN lead_months >= 6 THEN 0.80 ELSE 0.70 END) ELSE {weights('boost')} END AS wb FROM gated),
blended AS (SELECT *, CASE WHEN gate_alert THEN (1 - wb) * 0.75 ELSE {weights('trend')} END AS wt, CASE WHEN gate_alert THEN (1 - wb) * 0.25 ELSE {weights('foundation')} END AS wf FROM wts),
final AS (SELECT *, greatest(wt * pred_trend + wb * pred_boost + wf * pred_foundation, 1e-6) AS pred_blend FROM blended)"""


def gated(spark, sf):
    from monthgrid.operators.detect import gate

    rows = arms(spark, sf).withColumn("high", F.col("target") > 1.15 * F.col("pred_boost"))
    return gate(rows, ["high"])


@register(BOOK, "wn18_ts26_regime_blend", sql(BLEND, "SELECT mo, period, lead_months, gate_alert, round(CAST(wt AS DOUBLE), 6) AS w_trend, round(CAST(wb AS DOUBLE), 6) AS w_boost, round(CAST(wf AS DOUBLE), 6) AS w_foundation, round(pred_blend, 7) AS pred_blend FROM final"))
def ts26(spark, sf):
    rows = blend.regime_blend(gated(spark, sf)).select("mo", "period", "lead_months", "gate_alert", "w_trend", "w_boost", "w_foundation", "pred_blend")
    return r(rows, w_trend=6, w_boost=6, w_foundation=6, pred_blend=7)


@register(BOOK, "ts27_two_arm_gate", sql(BLEND, "SELECT mo, period, CAST(CASE WHEN gate_alert THEN 0.0 ELSE 0.4 END AS DOUBLE) AS w_foundation, round(greatest(CASE WHEN gate_alert THEN pred_boost ELSE 0.6 * pred_boost + 0.4 * pred_foundation END, 0), 7) AS pred_gated FROM gated"))
def ts27(spark, sf):
    return r(blend.two_arm_gate(gated(spark, sf)).select("mo", "period", "w_foundation", "pred_gated"), pred_gated=7)


@register(BOOK, "ts38_ts31_reblend", sql(BLEND, f""", fw AS (SELECT *, {weights('boost', table=blend.FACTORY)} AS w0, {weights('trend', table=blend.FACTORY)} AS t0, {weights('foundation', table=blend.FACTORY)} AS f0 FROM final),
fg AS (SELECT *, CASE WHEN gate_alert THEN greatest(w0, CASE WHEN lead_months >= 6 THEN 0.80 ELSE 0.70 END) ELSE w0 END AS w1 FROM fw),
fb AS (SELECT *, greatest(CASE WHEN gate_alert THEN (1 - w1) * 0.75 ELSE t0 END * pred_trend + w1 * pred_boost + CASE WHEN gate_alert THEN (1 - w1) * 0.25 ELSE f0 END * pred_foundation, 1e-6) AS pred_factory FROM fg),
c AS (SELECT lead_months, avg(abs(target - pred_blend)) AS a, avg(abs(target - pred_factory)) AS b FROM fb GROUP BY lead_months)
SELECT lead_months, round(a, 2) AS candidate_mae, round(b, 2) AS baseline_mae, round(100 * (b - a) / b, 5) AS delta_pct, CASE WHEN a < b - 1e-6 THEN 'better' WHEN a > b + 1e-6 THEN 'worse' ELSE 'even' END AS verdict FROM c""").replace("\n, fw", ", fw"))
def ts38(spark, sf):
    rows = gated(spark, sf)
    both, _ = flows.reblend(rows, rows.limit(0), blend.CALIBRATED)
    out = both.filter("fold = 'pooled' and model = 'pred_blend'").drop("fold", "model")
    return r(out, candidate_mae=2, baseline_mae=2, delta_pct=5)


@register(BOOK, "ts38_test_blend", sql(ARMS, f"SELECT mo, period, round({blend.CALIBRATED[6]['trend']} * pred_trend + {blend.CALIBRATED[6]['boost']} * pred_boost + {blend.CALIBRATED[6]['foundation']} * pred_foundation, 5) AS pred_blend FROM oof WHERE period >= DATE '2001-01-01'"))
def ts38b(spark, sf):
    """The test rows have no horizon of their own: all are blended at lead 6."""
    rows = arms(spark, sf)
    _, ahead = flows.reblend(rows, rows.filter("period >= '2001-01-01'").drop("lead_months", "target"), blend.CALIBRATED)
    return r(ahead.select("mo", "period", "pred_blend"), pred_blend=5)


@register(BOOK, "ts24_two_arm_weight", sql(ARMS, """, k AS (SELECT target, pred_boost AS b, pred_foundation AS f FROM oof WHERE isfinite(target) AND isfinite(pred_boost) AND isfinite(pred_foundation)),
lo AS (SELECT CASE WHEN avg(abs(target - f)) > 1.5 * avg(abs(target - b)) THEN 0.70 ELSE 0.5 END AS lo FROM k),
c AS (SELECT v, sum(w) OVER (ORDER BY v) AS upto, sum(w) OVER () AS total FROM (SELECT (target - f) / (b - f) AS v, sum(abs(b - f)) AS w FROM k WHERE b <> f GROUP BY 1)),
m AS (SELECT greatest(max(lo), least(min(v) FILTER (upto >= total / 2 * (1 - 1e-12)), 1.0)) AS w FROM c, lo)
SELECT round(w, 7) AS w_boost, round(avg(abs(target - (w * b + (1 - w) * f))), 3) AS mae FROM k, m GROUP BY w""").replace("\n, k", ", k"))
def ts24(spark, sf):
    return r(blend.fit_two_arms(arms(spark, sf)), w_boost=7, mae=3)


#: Every corner of the error's surface on the simplex: its corners, a zero residual on a side of it, and two zero residuals.
CORNERS = """, k AS (SELECT lead_months, row_number() OVER (ORDER BY lead_months, mo, period) AS i, target - pred_foundation AS t, pred_trend - pred_foundation AS x, pred_boost - pred_foundation AS z FROM oof),
v AS (SELECT lead_months, a, b FROM (SELECT DISTINCT lead_months FROM k), (VALUES (0.0, 0.0), (1.0, 0.0), (0.0, 1.0)) s(a, b)
 UNION ALL SELECT lead_months, t / x, 0.0 FROM k WHERE x <> 0 UNION ALL SELECT lead_months, 0.0, t / z FROM k WHERE z <> 0 UNION ALL SELECT lead_months, (t - z) / (x - z), 1 - (t - z) / (x - z) FROM k WHERE x <> z
 UNION ALL SELECT p.lead_months, (p.t * q.z - q.t * p.z) / (p.x * q.z - q.x * p.z), (p.x * q.t - q.x * p.t) / (p.x * q.z - q.x * p.z) FROM k p JOIN k q ON p.lead_months = q.lead_months AND p.i < q.i AND p.x * q.z <> q.x * p.z),
e AS (SELECT v.lead_months, a, b, avg(abs(t - a * x - b * z)) AS mae FROM (SELECT lead_months, CAST(a AS DOUBLE) AS a, CAST(b AS DOUBLE) AS b FROM v WHERE a >= 0 AND b >= 0 AND a + b <= 1) v JOIN k ON k.lead_months = v.lead_months GROUP BY ALL)"""


@register(BOOK, "ts25_simplex_weights", sql(ARMS, (CORNERS + """
SELECT lead_months, round(arg_min(a, mae), 5) AS w_trend, round(arg_min(b, mae), 5) AS w_boost, abs(round(1 - arg_min(a, mae) - arg_min(b, mae), 5)) AS w_foundation, round(min(mae), 4) AS mae FROM e GROUP BY lead_months""").replace("\n, k", ", k")))
def ts25(spark, sf):
    out = blend.fit_simplex(arms(spark, sf)).select("lead_months", "w_trend", "w_boost", "w_foundation", "mae")
    return r(out, w_trend=5, w_boost=5, w_foundation=5, mae=4)


@register(BOOK, "ts23_cold_start", sql(OBSERVED, """, l AS (SELECT mo, arg_max(y, period) AS last FROM obs WHERE mo <> 'NATION_3' GROUP BY mo), g AS (SELECT quantile_cont(y / nullif(b, 0) - 1, 0.5) AS g FROM (SELECT y, lag(y) OVER (PARTITION BY mo ORDER BY period) AS b FROM obs WHERE mo <> 'NATION_3') WHERE b IS NOT NULL), m AS (SELECT quantile_cont(y, 0.5) AS m FROM obs WHERE mo <> 'NATION_3')
SELECT e.mo, round(coalesce(greatest(last * (1 + g), 0), m), 5) AS forecast FROM (SELECT n_name AS mo FROM nation) e LEFT JOIN l ON l.mo = e.mo, g, m""").replace("\n, l", ", l"))
def ts23(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("mo"))
    return r(submit.cold_start(observed(spark, sf).filter("mo <> 'NATION_3'"), names), forecast=5)


@register(BOOK, "ts39_last_value_arm", sql(OBSERVED, "SELECT n_name AS mo, coalesce(last, 0.0) AS pred, 'fallback_last_value' AS mode FROM nation LEFT JOIN (SELECT mo, arg_max(y, period) AS last FROM obs WHERE mo <> 'NATION_3' GROUP BY mo) l ON l.mo = n_name"))
def ts39(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("mo"))
    return submit.last_value_arm(observed(spark, sf).filter("mo <> 'NATION_3'"), names)


@register(BOOK, "ts36_submission", sql(BLEND, """, e AS (SELECT DISTINCT mo FROM obs), m AS (SELECT unnest([DATE '2001-05-01', DATE '2001-06-01', DATE '2001-07-01', DATE '2001-08-01', DATE '2001-09-01']) AS period),
g AS (SELECT e.mo, m.period, b.pred_blend AS p FROM e CROSS JOIN m LEFT JOIN final b ON b.mo = e.mo AND b.period = m.period),
f AS (SELECT mo, period, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY mo ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(p IGNORE NULLS) OVER (PARTITION BY mo ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS near FROM g)
SELECT mo, f.period, round(coalesce(near, pm), 7) AS pred FROM f LEFT JOIN (SELECT period, quantile_cont(near, 0.5) AS pm FROM f GROUP BY period) q ON q.period = f.period ORDER BY mo, f.period""").replace("\n, e", ", e"))
def ts36(spark, sf):
    """The gated blend of the arms on the whole grid; months and entities without a prediction are filled."""
    months = spark.createDataFrame([(f"2001-0{k}-01",) for k in range(5, 10)], "d string").select(F.col("d").cast("date").alias("period"))
    preds = blend.regime_blend(gated(spark, sf)).join(F.broadcast(months), "period", "left_semi").select("mo", "period", F.col("pred_blend").alias("pred"))
    return r(submit.assemble(observed(spark, sf).select("mo").distinct(), months, preds, fill=True), pred=7)


@register(BOOK, "ts40_chosen_arm", sql(ARMS, "SELECT mo, period, pred_boost AS pred FROM oof"))
def ts40(spark, sf):
    """The arm asked for, over as many entities as the roster has; an arm that isn't there, or a roster of another size, is an error."""
    rows = arms(spark, sf)
    return submit.select_arm(rows, "pred_boost", rows.select("mo").distinct().count()).select("mo", "period", "pred")


GIVEN = {6: {"trend": 1, "boost": 3, "foundation": 0}, 12: {"trend": 2, "boost": 1, "foundation": 1}}
MERGED = blend.FACTORY | {h: {a: v / sum(w.values()) for a, v in w.items()} for h, w in GIVEN.items()}


@register(BOOK, "ts28_weight_file", sql(ARMS, f"SELECT mo, period, lead_months, round(greatest(({weights('trend', table=MERGED)}) * pred_trend + ({weights('boost', table=MERGED)}) * pred_boost + ({weights('foundation', table=MERGED)}) * pred_foundation, 1e-6), 5) AS pred_blend FROM oof"))
def ts28(spark, sf):
    """Weights of two horizons from a file, scaled, over the factory's."""
    import json

    from monthgrid.plans.roundtrips import place
    from monthgrid.sources.sinks import put_text

    path = f"{place(spark, 'weights')}.json"
    put_text(spark, path, json.dumps(GIVEN))
    table_ = blend.load_weights(path, spark=spark)
    rows = arms(spark, sf).withColumn("gate_alert", F.lit(False))
    return r(blend.regime_blend(rows, table_).select("mo", "period", "lead_months", "pred_blend"), pred_blend=5)


@register(BOOK, "ts29_ablation", sql(ARMS, """, d AS (SELECT *, period + INTERVAL 20 DAY AS base_at, period + INTERVAL (lead_months) DAY AS news_at FROM oof),
s AS (SELECT fold, count(*) AS n, avg(abs(target - pred_trend)) AS a, avg(abs(target - pred_boost)) AS b, avg(date_diff('day', period, base_at)) AS da, avg(date_diff('day', period, news_at)) AS db FROM d GROUP BY fold)
SELECT fold, n, 'measured' AS status, round(a, 2) AS mae_without, round(b, 2) AS mae_with, round(a - b, 2) AS mae_delta, round(100 * (a - b) / a, 5) AS improvement_pct, round(da, 6) AS delay_without, round(db, 6) AS delay_with, round(da - db, 6) AS delay_reduction FROM s""").replace("\n, d", ", d"))
def ts29(spark, sf):
    rows = arms(spark, sf).withColumns({
        "origin": F.col("period"), "news_available_at": F.col("period").cast("timestamp") - F.expr("interval 1 microsecond"), "event_period": F.col("period"),
        "baseline_detected_at": F.date_add("period", 20), "news_detected_at": F.date_add("period", F.col("lead_months"))})
    return r(evidence.ablation(rows, "pred_trend", "pred_boost", by_=["fold"]), mae_without=2, mae_with=2, mae_delta=2, improvement_pct=5, delay_without=6, delay_with=6, delay_reduction=6)


@register(BOOK, "ts30_foundation_payload", sql(LONG, f"SELECT lead_months, 'pred_foundation' AS model, CASE WHEN mae IS NULL THEN 'not_evaluated' ELSE 'measured' END AS status, mae, r2, wape FROM (SELECT unnest([1, 3, 6, 12, 24]) AS lead_months) LEFT JOIN (SELECT lead_months, {SCORES} FROM long WHERE model = 'pred_foundation' GROUP BY lead_months) USING (lead_months)"))
def ts30(spark, sf):
    scores = metrics.pooled(long(spark, sf), ["lead_months", "model"])
    return shown(evidence.benchmark_rows(scores, "pred_foundation", [1, 3, 6, 12, 24]))


@register(BOOK, "ts37_local_news_shock", f"WITH f AS ({FEATURES}), {MACRO} SELECT mo, f.period, round(discount * spending_volatility, 7) AS local_news_shock FROM f LEFT JOIN macro m ON f.period = m.period + INTERVAL 1 MONTH")
def ts37(spark, sf):
    rows = joins.attach(flagship(spark, sf), macro(spark, sf).withColumnRenamed("discount", "news_shock_score"), ["period"], lag=1)
    return r(evidence.local_shock(rows).select("mo", "period", "local_news_shock"), local_news_shock=7)
