"""Queries of the structural-break detectors and what is made of their alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthgrid.operators import detect, evidence, topology
from monthgrid.plans.book import ARMS, MONTH, OBSERVED, PANEL, register, sql
from monthgrid.plans.joining import arms
from monthgrid.plans.panels import observed, panel, r

BOOK: dict = {}
P24 = "ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING"
RES = ARMS + f""", res AS (SELECT mo, period, abs(target - pred_boost) AS s, target - pred_boost AS residual FROM oof),
bar AS (SELECT *, CASE WHEN count(s) OVER p >= 4 THEN s / greatest(least(avg(s) OVER p + 1.8 * stddev_samp(s) OVER p, quantile_cont(s, 0.9) OVER p), 1e-8) END AS score FROM res WINDOW p AS (PARTITION BY mo ORDER BY period {P24})),
alarms AS (SELECT mo, period, score, score IS NOT NULL AS eligible, coalesce(score >= 1, FALSE) AS shock, month(period) IN (2, 7) AS news_alert, month(period) <> 9 AS news_eligible FROM bar)"""


def residuals(spark, sf):
    rows = arms(spark, sf).select("mo", "period", (F.col("target") - F.col("pred_boost")).alias("residual"))
    m = F.month("period")
    return detect.residual_barrier(rows).withColumns({"news_alert": m.isin(2, 7), "news_eligible": m != 9})


@register(BOOK, "ts3_residual_barrier", sql(RES, "SELECT mo, period, round(score, 5) AS residual_score, eligible AS residual_eligible, shock AS residual_shock FROM alarms"))
def ts3(spark, sf):
    return r(residuals(spark, sf).select("mo", "period", "residual_score", "residual_eligible", "residual_shock"), residual_score=5)


@register(BOOK, "ts4_residual_news", sql(RES, "SELECT mo, period, eligible AND coalesce(bool_or(news_eligible) OVER w, FALSE) AS residual_news_eligible, eligible AND coalesce(bool_or(news_eligible) OVER w, FALSE) AND coalesce(bool_or(news_alert) OVER w, FALSE) AND coalesce(score > 1, FALSE) AS residual_news_shock FROM alarms WINDOW w AS (PARTITION BY mo ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"))
def ts4(spark, sf):
    return detect.residual_news(residuals(spark, sf)).select("mo", "period", "residual_news_eligible", F.coalesce("residual_news_shock", F.lit(False)).alias("residual_news_shock"))


@register(BOOK, "ag5_alert_share", sql(RES, "SELECT period, count(*) FILTER (eligible) AS eligible, round(count(*) FILTER (shock AND eligible) / nullif(count(*) FILTER (eligible), 0), 6) AS share FROM alarms GROUP BY period"))
def ag5(spark, sf):
    return r(detect.alert_share(residuals(spark, sf), "residual_shock", "residual_eligible"), share=6)


@register(BOOK, "ag13_macro_events", sql(RES, f""", sh AS (SELECT period, count(*) FILTER (shock AND eligible) / nullif(count(*) FILTER (eligible), 0) AS share FROM alarms GROUP BY period),
h AS (SELECT *, {MONTH.format('period')} - row_number() OVER (ORDER BY period) AS island FROM sh WHERE share >= 0.085),
k AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY island ORDER BY period) - 1) / 2) AS INTEGER) AS pair FROM h)
SELECT period AS event, round(share, 6) AS share FROM k QUALIFY row_number() OVER (PARTITION BY island, pair ORDER BY share DESC, period) = 1""").replace("\n, sh", ", sh"))
def ag13(spark, sf):
    shares = detect.alert_share(residuals(spark, sf), "residual_shock", "residual_eligible")
    return r(detect.macro_events(shares), share=6)


@register(BOOK, "pf11_detected_months", sql(RES, "SELECT DISTINCT period FROM alarms WHERE shock ORDER BY period"))
def pf11(spark, sf):
    return evidence.detected_months(residuals(spark, sf), "residual")


@register(BOOK, "ts1_series_checks", sql(PANEL, f"SELECT mo, count(*) AS n, TRUE AS unique_months, max({MONTH.format('period')}) - min({MONTH.format('period')}) + 1 = count(*) AS contiguous, count(y) = count(*) AS finite FROM panel GROUP BY mo"))
def ts1(spark, sf):
    return detect.check_series(panel(spark, sf))


TAKENS = OBSERVED + """, v AS (SELECT mo, period, lag(y, 4) OVER w AS a, lag(y, 3) OVER w AS b, lag(y, 2) OVER w AS c, lag(y, 1) OVER w AS d, y AS e FROM obs WINDOW w AS (PARTITION BY mo ORDER BY period)),
sd AS (SELECT *, list_stddev_pop([a, b, c]) AS s1, list_stddev_pop([b, c, d]) AS s2, list_stddev_pop([c, d, e]) AS s3 FROM v),
ds AS (SELECT mo, period, CASE WHEN a IS NOT NULL THEN list_sort([sqrt(pow((a - b) / s1, 2) + pow((b - c) / s2, 2) + pow((c - d) / s3, 2)), sqrt(pow((a - c) / s1, 2) + pow((b - d) / s2, 2) + pow((c - e) / s3, 2)), sqrt(pow((b - c) / s1, 2) + pow((c - d) / s2, 2) + pow((d - e) / s3, 2))]) END AS l FROM sd),
pr AS (SELECT mo, period, l[1] AS x, l[2] AS y, lag(l[1]) OVER w AS px, lag(l[2]) OVER w AS py FROM ds WINDOW w AS (PARTITION BY mo ORDER BY period)),
td AS (SELECT mo, period, -(x / (x + y)) * ln(x / (x + y)) - (y / (x + y)) * ln(y / (x + y)) AS ent,
  CASE WHEN px IS NOT NULL THEN least(least(abs(x - px), (x + px) / sqrt(2)) + least(abs(y - py), (y + py) / sqrt(2)), least(abs(x - py), (x + py) / sqrt(2)) + least(abs(y - px), (y + px) / sqrt(2))) END AS dist FROM pr),
tda AS (SELECT mo, period, lag(ent) OVER w AS tda_entropy, lag(dist) OVER w AS tda_distance FROM td WINDOW w AS (PARTITION BY mo ORDER BY period))"""


@register(BOOK, "ts8_ts12_topology", sql(TAKENS, "SELECT mo, period, round(tda_entropy, 6) AS tda_entropy, round(tda_distance, 6) AS tda_distance FROM tda"))
def ts8(spark, sf):
    return r(topology.features(observed(spark, sf)), tda_entropy=6, tda_distance=6)


@register(BOOK, "ts8_ts11_wide_topology")
def ts8b(spark, sf):
    """Windows of a year, embedded with a delay of two months: loops, or components where there is none."""
    return r(topology.wide_features(observed(spark, sf), width=12, dimension=3, delay=2), tda_entropy=6, tda_distance=6)


@register(BOOK, "ts8_ts11_general_topology", sql(TAKENS, "SELECT mo, period, round(tda_entropy, 6) AS tda_entropy, round(tda_distance, 6) AS tda_distance FROM tda"))
def ts8c(spark, sf):
    """The general path at the usual width agrees with column arithmetic."""
    return r(topology.wide_features(observed(spark, sf), width=5), tda_entropy=6, tda_distance=6)


@register(BOOK, "wn9_distance_alert", sql(TAKENS, f"SELECT mo, period, coalesce(able, FALSE) AS tda_eligible, coalesce(able AND tda_distance >= q, FALSE) AS tda_shock FROM (SELECT *, q IS NOT NULL AND k >= 4 AS able FROM (SELECT *, row_number() OVER (PARTITION BY mo ORDER BY period) - 1 AS k, CASE WHEN count(tda_distance) OVER p >= 3 THEN quantile_cont(tda_distance, 0.85) OVER p END AS q FROM tda WINDOW p AS (PARTITION BY mo ORDER BY period {P24})))"))
def wn9(spark, sf):
    return detect.distance_alert(topology.features(observed(spark, sf)), "tda_distance").select("mo", "period", "tda_eligible", "tda_shock")


@register(BOOK, "wn10_sigma_alert", sql(TAKENS, "SELECT mo, period, coalesce(count(tda_distance) OVER p >= 3 AND stddev_samp(tda_distance) OVER p >= 1e-10 AND tda_distance > avg(tda_distance) OVER p + 1.0 * stddev_samp(tda_distance) OVER p, FALSE) AS alert FROM tda WINDOW p AS (PARTITION BY mo ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
def wn10(spark, sf):
    rows = topology.features(observed(spark, sf))
    return rows.select("mo", "period", topology.sigma_alert(rows, k=1.0).alias("alert"))


FLAGGED = RES + """, fl AS (SELECT a.mo, a.period, a.shock AS cusum_shock, month(a.period) % 3 = 0 AS tda_shock, month(a.period) % 2 = 0 AS pelt_shock, a.news_alert FROM alarms a)"""


def flagged(spark, sf):
    m = F.month("period")
    return residuals(spark, sf).select("mo", "period", F.col("residual_shock").alias("cusum_shock"), (m % 3 == 0).alias("tda_shock"), (m % 2 == 0).alias("pelt_shock"), "news_alert")


@register(BOOK, "wn19_consensus", sql(FLAGGED, "SELECT f.mo, f.period, f.cusum_shock OR (f.tda_shock AND f.pelt_shock) OR (coalesce(b.tda_shock, FALSE) AND f.news_alert) AS consensus_shock FROM fl f LEFT JOIN fl b ON b.mo = f.mo AND b.period = f.period - INTERVAL 1 MONTH"))
def wn19(spark, sf):
    return detect.consensus(flagged(spark, sf)).select("mo", "period", "consensus_shock")


@register(BOOK, "j14_near_flag", sql(FLAGGED, "SELECT mo, period, tda_shock AND coalesce(bool_or(news_alert) OVER w, FALSE) AS synergy FROM fl WINDOW w AS (PARTITION BY mo ORDER BY period ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)"))
def j14(spark, sf):
    rows = flagged(spark, sf)
    return rows.select("mo", "period", (F.col("tda_shock") & detect.near_flag(rows, "news_alert", 1)).alias("synergy"))


@register(BOOK, "ts34_lead_lag", sql(FLAGGED, f""", t AS (SELECT DISTINCT period FROM fl WHERE tda_shock), n AS (SELECT DISTINCT period FROM fl WHERE news_alert)
SELECT t.period, CAST(min({MONTH.format('n.period')} - {MONTH.format('t.period')}) AS INTEGER) AS to_earliest, CAST(min(abs({MONTH.format('n.period')} - {MONTH.format('t.period')})) AS INTEGER) AS to_nearest FROM t, n GROUP BY t.period""").replace("\n, t", ", t"))
def ts34(spark, sf):
    """Both readings of a lead: to the earliest and to the nearest news month."""
    rows = flagged(spark, sf)
    return evidence.lead_lag(evidence.detected_months(rows, "tda"), rows.filter("news_alert"))


@register(BOOK, "ts35_territorial_fallback", sql(PANEL, f"SELECT mo, period, q IS NOT NULL AS residual_eligible, coalesce(s >= q, FALSE) AS residual_shock, CASE WHEN q IS NOT NULL THEN round(s / greatest(q, 1e-8), 5) END AS residual_score, CAST(period + INTERVAL 1 MONTH AS DATE) AS detected_at FROM (SELECT mo, period, s, CASE WHEN count(s) OVER p >= 4 THEN quantile_cont(s, 0.9) OVER p END AS q FROM (SELECT mo, period, abs(y - lag(y) OVER (PARTITION BY mo ORDER BY period)) AS s FROM panel) WINDOW p AS (PARTITION BY mo ORDER BY period {P24}))"))
def ts35(spark, sf):
    return r(evidence.territorial_fallback(panel(spark, sf)).drop("y", "residual"), residual_score=5)


@register(BOOK, "ts32_news_validation", sql(RES, """, nv AS (SELECT period, greatest(avg(CAST(coalesce(score >= 1, FALSE) AS INTEGER)), avg(CAST(month(period) % 5 = 0 AS INTEGER))) AS share, avg(abs(residual)) AS size, max(CASE WHEN year(period) % 2 = 0 THEN -month(period) ELSE month(period) END * 1.0) AS news FROM bar GROUP BY period),
l AS (SELECT share, size, lag(abs(news)) OVER (ORDER BY period) AS news FROM nv), k AS (SELECT * FROM l WHERE news IS NOT NULL), q AS (SELECT quantile_cont(news, 0.75) AS b FROM k)
SELECT count(*) AS months, count(*) FILTER (news >= b) AS peaks, count(*) FILTER (share >= 0.085) AS alerts, count(*) FILTER (news >= b AND share >= 0.085) AS validated, round(count(*) FILTER (news >= b AND share >= 0.085) / count(*) FILTER (news >= b OR share >= 0.085), 6) AS jaccard,
 round(corr(news, share), 6) AS correlation_share, round(corr(news, size), 6) AS correlation_size, CASE WHEN count(*) FILTER (news >= b AND share >= 0.085) > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS lead_months FROM k, q""").replace("\n, nv", ", nv"))
def ts32(spark, sf):
    m = F.month("period")
    rows = residuals(spark, sf).withColumns({"pelt_shock": m % 5 == 0, "news_shock_score": F.when(F.year("period") % 2 == 0, -m).otherwise(m) * 1.0})
    return r(evidence.news_validation(rows, ["residual_shock", "pelt_shock"]), jaccard=6, correlation_share=6, correlation_size=6)


@register(BOOK, "ts2_cusum", sql(PANEL, """, s AS (SELECT mo, period, y, row_number() OVER (PARTITION BY mo ORDER BY period) AS i FROM panel WHERE y IS NOT NULL),
b AS (SELECT mo, avg(y) AS m, greatest(stddev_samp(y), 1e-8) AS d FROM s WHERE i <= 4 GROUP BY mo),
z AS (SELECT s.mo, period, i, (y - m) / d AS z FROM s JOIN b USING (mo)),
w AS (SELECT mo, i, 0.0::DOUBLE AS score, FALSE AS alarm, 0.0::DOUBLE AS p, 0.0::DOUBLE AS n FROM z WHERE i = 4 UNION ALL
 SELECT mo, i, greatest(a, c) / 2.0, greatest(a, c) / 2.0 >= 1, CASE WHEN greatest(a, c) / 2.0 >= 1 THEN 0 ELSE a END, CASE WHEN greatest(a, c) / 2.0 >= 1 THEN 0 ELSE c END FROM (SELECT z.mo, z.i, greatest(0, p + z - 0.5) AS a, greatest(0, n - z - 0.5) AS c FROM w JOIN z ON z.mo = w.mo AND z.i = w.i + 1))
SELECT z.mo, z.period, CASE WHEN z.i > 4 THEN round(w.score, 5) END AS cusum_score, coalesce(w.alarm, FALSE) AS cusum_shock, z.i > 4 AS cusum_eligible FROM z LEFT JOIN w ON w.mo = z.mo AND w.i = z.i""").replace("WITH obs", "WITH RECURSIVE obs", 1).replace("\n, s AS", ", s AS"))
def ts2(spark, sf):
    return r(detect.cusum(panel(spark, sf)), cusum_score=5)


@register(BOOK, "ts5_pelt")
def ts5(spark, sf):
    return r(detect.segmentation(panel(spark, sf), "pelt"), pelt_score=6)


@register(BOOK, "ts6_binary_segmentation")
def ts6(spark, sf):
    return r(detect.segmentation(panel(spark, sf), "binseg"), binseg_score=6)


@register(BOOK, "ts7_retrospective_benchmark")
def ts7(spark, sf):
    pooled = observed(spark, sf).groupBy("period").agg(F.percentile("y", F.lit(0.5)).alias("y"))
    return detect.retrospective(pooled)


EVENTS = ["1997-03-10", "1998-10-05", "1999-08-20", "2000-12-01", "2001-07-15"]


def detections(spark, sf):
    rows = flagged(spark, sf)
    share = lambda c, n: rows.groupBy("period").agg((F.avg(F.col(c).cast("int")) >= 0.085).alias("on")).filter("on").select(F.lit(n).alias("method"), F.col("period").alias("detected"))
    return share("cusum_shock", "cusum").union(share("tda_shock", "tda")).union(share("news_alert", "news"))


MATCHED = "RECURSIVE " + FLAGGED + f""", det AS (SELECT 'cusum' AS method, period AS detected FROM fl GROUP BY period HAVING avg(CAST(cusum_shock AS INTEGER)) >= 0.085 UNION ALL SELECT 'tda', period FROM fl GROUP BY period HAVING avg(CAST(tda_shock AS INTEGER)) >= 0.085 UNION ALL SELECT 'news', period FROM fl GROUP BY period HAVING avg(CAST(news_alert AS INTEGER)) >= 0.085),
ev AS (SELECT unnest([{', '.join(f"DATE '{e}'" for e in EVENTS)}]) AS event),
cand AS (SELECT method, detected, event, date_diff('day', event, detected) AS delay, row_number() OVER (PARTITION BY method ORDER BY abs(date_diff('day', event, detected)), detected, event) AS rn FROM det, ev WHERE abs(date_diff('day', event, detected)) <= 31),
pick AS (SELECT method, CAST(0 AS BIGINT) AS rn, CAST([] AS DATE[]) AS ud, CAST([] AS DATE[]) AS ue, FALSE AS took, CAST(NULL AS DATE) AS detected, CAST(NULL AS DATE) AS event, CAST(0 AS BIGINT) AS delay FROM (SELECT DISTINCT method FROM cand)
 UNION ALL SELECT method, rn, CASE WHEN ok THEN list_append(ud, detected) ELSE ud END, CASE WHEN ok THEN list_append(ue, event) ELSE ue END, ok, detected, event, delay FROM
  (SELECT c.*, p.ud, p.ue, NOT list_contains(p.ud, c.detected) AND NOT list_contains(p.ue, c.event) AS ok FROM pick p JOIN cand c ON c.method = p.method AND c.rn = p.rn + 1)),
mt AS (SELECT method, detected, event, CAST(delay AS INTEGER) AS delay FROM pick WHERE took)"""


def catalogue(spark):
    return spark.createDataFrame([(e,) for e in EVENTS], "e string").select(F.col("e").cast("date").alias("event"))


@register(BOOK, "j13_event_matching", sql(MATCHED, "SELECT method, detected, event, delay FROM mt"))
def j13(spark, sf):
    return detect.match_events(detections(spark, sf), catalogue(spark))


@register(BOOK, "ag12_event_scores", sql(MATCHED, """, d AS (SELECT method, count(*) AS detected FROM det GROUP BY method),
s AS (SELECT d.method, d.detected, coalesce(k.n, 0) AS matched, k.lead, k.late, coalesce(k.n, 0) / d.detected AS p, coalesce(k.n, 0) / 5.0 AS q FROM d LEFT JOIN (SELECT method, count(*) AS n, avg(delay) AS lead, avg(greatest(delay, 0)) / 30.4375 AS late FROM mt GROUP BY method) k ON k.method = d.method)
SELECT method, detected, matched, CAST(5 AS BIGINT) AS events, CAST(0 AS BIGINT) AS out_of_range, round(lead, 6) AS mean_lead_days, round(p, 6) AS precision, round(CAST(q AS DOUBLE), 6) AS recall, round(CASE WHEN p + q > 0 THEN 2 * p * q / (p + q) ELSE 0 END, 6) AS f1, round(CAST(100 * q AS DOUBLE), 4) AS coverage, round(late, 6) AS mean_delay FROM s""").replace("\n, d", ", d"))
def ag12(spark, sf):
    return r(detect.event_scores(detections(spark, sf), catalogue(spark)), precision=6, recall=6, f1=6, coverage=4, mean_delay=6, mean_lead_days=6)
