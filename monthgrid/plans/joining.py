"""Queries of the joins and the panel aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthgrid.functions.calendar import month_start
from monthgrid.operators import joins, subset
from monthgrid.operators.panel import direct
from monthgrid.operators.windows import by
from monthgrid.plans.book import ARMS, MONTH, OBSERVED, PANEL, register, sql
from monthgrid.plans.panels import observed, panel
from monthgrid.session import table
from monthgrid.sources.files import category_history, coverage, load_macro, news_table, prediction_cache, roster, wide

BOOK: dict = {}

MACRO = """macro AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(avg(l_discount), 8) AS discount FROM lineitem GROUP BY ALL)"""


def macro(spark, sf):
    return table(spark, sf, "lineitem").groupBy(month_start(F.col("l_shipdate")).alias("period")).agg(F.round(F.avg("l_discount"), 8).alias("discount"))


@register(BOOK, "j1_monthly_left_join", sql(PANEL + ", " + MACRO, "SELECT mo, p.period, y, discount FROM panel p LEFT JOIN macro m ON p.period = m.period"))
def j1(spark, sf):
    return joins.attach(panel(spark, sf), macro(spark, sf), ["period"]).select("mo", "period", "y", "discount")


@register(BOOK, "j2_entity_month_join", sql(PANEL, "SELECT a.mo, a.period, a.y, b.n FROM panel a LEFT JOIN (SELECT n_name AS mo, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL) b ON a.mo = b.mo AND a.period = b.period"))
def j2(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    counts = n.groupBy(F.col("n_name").alias("mo"), month_start(F.col("o_orderdate")).alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return joins.attach(panel(spark, sf), counts, ["mo", "period"]).select("mo", "period", "y", "n")


@register(BOOK, "j3_calendar_lag_join", sql(PANEL + ", " + MACRO, "SELECT mo, p.period, y, discount FROM panel p LEFT JOIN macro m ON p.period = m.period + INTERVAL 2 MONTH"))
def j3(spark, sf):
    return joins.attach(panel(spark, sf), macro(spark, sf), ["period"], lag=2).select("mo", "period", "y", "discount")


@register(BOOK, "j4_horizon_self_join", sql(OBSERVED, "SELECT a.mo, a.period AS origin, b.y AS target FROM obs a JOIN obs b ON a.mo = b.mo AND b.period = a.period + INTERVAL 6 MONTH"))
def j4(spark, sf):
    return direct(observed(spark, sf), 6).select("mo", "origin", "target")


VINTAGE = """v AS (SELECT l_suppkey AS supplier, CAST(l_shipdate AS DATE) AS released, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL),
rows_ AS (SELECT DISTINCT l_suppkey AS supplier, CAST(date_trunc('month', l_shipdate) AS DATE) AS period FROM lineitem)"""


@register(BOOK, "j5_asof_strict", sql(VINTAGE, "SELECT r.supplier, r.period, v.q, v.released FROM rows_ r ASOF LEFT JOIN v ON r.supplier = v.supplier AND r.period > v.released"))
def j5(spark, sf):
    li = table(spark, sf, "lineitem")
    v = li.groupBy(F.col("l_suppkey").alias("supplier"), F.col("l_shipdate").cast("date").alias("released")).agg(F.round(F.sum("l_quantity"), 2).alias("q"))
    rows = li.select(F.col("l_suppkey").alias("supplier"), month_start(F.col("l_shipdate")).alias("period")).distinct()
    out = joins.asof_strict(rows, v, ["supplier"], "period", "released", "q")
    return out.select("supplier", "period", "q", F.col("q_since").cast("date").alias("released"))


@register(BOOK, "j6_asof_fill", sql(OBSERVED, """, h AS (SELECT mo, period, CASE WHEN month(period) % 3 = 0 THEN 0 WHEN month(period) % 3 = 1 THEN -y ELSE y END AS y FROM obs WHERE mo <> 'NATION_3'),
t AS (SELECT mo, CAST(m AS DATE) AS period FROM (SELECT DISTINCT mo FROM obs) CROSS JOIN (SELECT unnest([DATE '1998-01-01', DATE '1999-06-01', DATE '2001-01-01']) AS m))
SELECT t.mo, t.period, coalesce(h.y, med) AS filled, CASE WHEN h.y IS NOT NULL THEN 'history' WHEN med IS NOT NULL THEN 'median' END AS fill_source
FROM t ASOF LEFT JOIN (SELECT * FROM h WHERE y > 0) h ON t.mo = h.mo AND t.period > h.period
LEFT JOIN (SELECT m.period AS p, round(quantile_cont(y, 0.5), 5) AS med FROM (SELECT DISTINCT period FROM t) m JOIN h ON h.period < m.period WHERE h.y > 0 GROUP BY m.period) ON p = t.period""").replace("\n, h", ", h"))
def j6(spark, sf):
    rows = observed(spark, sf)
    months = spark.createDataFrame([("1998-01-01",), ("1999-06-01",), ("2001-01-01",)], "d string").select(F.col("d").cast("date").alias("period"))
    asked = rows.select("mo").distinct().crossJoin(F.broadcast(months))
    signed = F.when(F.month("period") % 3 == 0, 0.0).when(F.month("period") % 3 == 1, -F.col("y")).otherwise(F.col("y"))
    out = joins.last_positive_before(rows.filter("mo <> 'NATION_3'").withColumn("y", signed), asked)
    return out.withColumn("filled", F.round("filled", 5))


@register(BOOK, "j7_sc17_prediction_cache", sql(ARMS, """SELECT coalesce(a.mo, b.mo) AS mo, coalesce(a.period, b.period) AS period, a.pred_trend AS pred_trend, round(b.pred_boost, 4) AS pred_boost, a.target AS target
FROM (SELECT * FROM oof WHERE month(period) <> 2) a FULL JOIN (SELECT * FROM oof WHERE month(period) <> 5) b ON a.mo = b.mo AND a.period = b.period WHERE a.target IS NOT NULL"""))
def j7(spark, sf):
    rows = arms(spark, sf)
    a = rows.filter(F.month("period") != 2).select("mo", "period", F.col("pred_trend").alias("pred"), "target")
    b = rows.filter(F.month("period") != 5).select("mo", "period", F.round("pred_boost", 4).alias("pred"))
    return prediction_cache({"trend": a, "boost": b})[0].select("mo", "period", "pred_trend", "pred_boost", "target")


def arms(spark, sf):
    """Three arms made from the panel itself, with a horizon and a fold for each row (see book.ARMS)."""
    w = by()
    p3 = w.rowsBetween(-3, -1)
    m3 = F.when(F.count("y").over(p3) == 3, F.avg("y").over(p3))
    rows = panel(spark, sf).select("mo", "period", F.col("y").alias("target"), F.lag("y", 1).over(w).alias("pred_trend"), m3.alias("pred_boost"), F.lag("y", 12).over(w).alias("pred_foundation"))
    q = F.month("period") % 4
    lead = F.when(q == 0, 1).when(q == 1, 3).when(q == 2, 6).otherwise(12)
    return rows.dropna().withColumns({"lead_months": lead, "fold": (F.year("period") % 3).cast("int")})


@register(BOOK, "j8_grid", sql(OBSERVED, "SELECT r.mo, m.period, y FROM (SELECT DISTINCT mo FROM obs) r CROSS JOIN (SELECT DISTINCT period FROM obs WHERE period >= DATE '2001-01-01') m LEFT JOIN obs ON obs.mo = r.mo AND obs.period = m.period"))
def j8(spark, sf):
    from monthgrid.operators.submit import grid

    rows = observed(spark, sf)
    return grid(rows, rows.filter(F.col("period") >= "2001-01-01")).join(rows, ["mo", "period"], "left")


REGION = """n AS (SELECT n_name, n_nationkey, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
s AS (SELECT lower(r_name) AS region, s_acctbal AS wage, row_number() OVER (PARTITION BY lower(r_name) ORDER BY s_suppkey DESC) AS k FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA')"""


@register(BOOK, "j9_region_join", sql(REGION, "SELECT n.n_name, n.region, s.wage, s.wage IS NOT NULL AS regional_match FROM n LEFT JOIN s ON n.region = s.region AND k = 1"))
def j9(spark, sf):
    n, rg = table(spark, sf, "nation"), table(spark, sf, "region")
    named = n.join(F.broadcast(rg), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "n_nationkey", F.lower("r_name").alias("region"), "r_name")
    wages = table(spark, sf, "supplier").join(F.broadcast(named), F.col("s_nationkey") == F.col("n_nationkey")).filter("r_name <> 'ASIA'").select("region", F.col("s_acctbal").alias("wage"), "s_suppkey")
    return joins.attach_region(named.select("n_name", "region"), wages, "region", "s_suppkey", ["wage"])


@register(BOOK, "j10_crosswalk", """WITH x AS (SELECT CAST(CASE WHEN c_custkey % 3 = 0 THEN c_custkey ELSE -1 - c_custkey % 40 END AS VARCHAR) AS code, c_mktsegment || CAST(c_custkey % 60 AS VARCHAR) AS name, CAST(c_nationkey AS VARCHAR) AS region, c_custkey AS id FROM customer),
q AS (SELECT CAST(CASE WHEN s_suppkey % 5 = 1 THEN -1 - s_suppkey % 40 ELSE s_suppkey END AS VARCHAR) AS code, CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END || CAST(s_suppkey % 60 AS VARCHAR) AS name, CAST(s_nationkey AS VARCHAR) AS region FROM supplier),
c AS (SELECT code, count(*) AS n_code, min(id) AS id_code FROM x GROUP BY code), d AS (SELECT name, region, count(*) AS n_name, min(id) AS id_name FROM x GROUP BY name, region)
SELECT q.code, q.name, q.region, CASE WHEN n_code = 1 THEN CAST(id_code AS VARCHAR) WHEN n_name = 1 THEN CAST(id_name AS VARCHAR) ELSE q.region || '::' || q.name END AS id,
 CASE WHEN n_code = 1 THEN 'exact' WHEN n_name = 1 THEN 'crosswalk' WHEN n_code > 1 OR n_name > 1 THEN 'ambiguous' ELSE 'inferred' END AS status,
 CAST(CASE WHEN n_code = 1 THEN 1.0 WHEN n_name = 1 THEN 0.95 WHEN n_code > 1 OR n_name > 1 THEN 0.2 ELSE 0.55 END AS DOUBLE) AS confidence
FROM q LEFT JOIN c ON q.code = c.code LEFT JOIN d ON q.name = d.name AND q.region = d.region""")
def j10(spark, sf):
    s = lambda c: F.col(c).cast("string")
    x = table(spark, sf, "customer").select(
        F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey")).otherwise(-1 - F.col("c_custkey") % 40).cast("string").alias("code"), F.concat("c_mktsegment", (F.col("c_custkey") % 60).cast("string")).alias("name"), s("c_nationkey").alias("region"), s("c_custkey").alias("id"))
    q = table(spark, sf, "supplier").select(
        F.when(F.col("s_suppkey") % 5 == 1, -1 - F.col("s_suppkey") % 40).otherwise(F.col("s_suppkey")).cast("string").alias("code"),
        F.concat(F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY"), (F.col("s_suppkey") % 60).cast("string")).alias("name"), s("s_nationkey").alias("region"))
    return joins.resolve(q, x)


@register(BOOK, "j11_semi_anti", "SELECT c_custkey, 'active' AS part FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'cold' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def j11(spark, sf):
    c, o = table(spark, sf, "customer").select("c_custkey"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("part", F.lit("active")).union(c.join(o, "c_custkey", "left_anti").withColumn("part", F.lit("cold")))


@register(BOOK, "j12_map_lookup", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' END AS state FROM orders")
def j12(spark, sf):
    names = spark.createDataFrame([("F", "finished"), ("O", "open")], "o_orderstatus string, state string")
    return table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(F.broadcast(names), "o_orderstatus", "left").select("o_orderkey", "state")


@register(BOOK, "j15_prior_news_lag", sql(OBSERVED, f"SELECT o.mo, o.period, CAST(min({MONTH.format('o.period')} - {MONTH.format('n.period')}) AS INTEGER) AS news_lag FROM obs o LEFT JOIN (SELECT DISTINCT period FROM obs WHERE month(period) IN (3, 10)) n ON n.period <= o.period AND n.period >= o.period - INTERVAL 4 MONTH GROUP BY o.mo, o.period"))
def j15(spark, sf):
    rows = observed(spark, sf).select("mo", "period")
    return joins.prior_news_lag(rows, rows.filter(F.month("period").isin(3, 10)), 4).select("mo", "period", "news_lag")


@register(BOOK, "sc5_ag1_macro_series", "SELECT CAST(date_trunc('month', l_shipdate) + INTERVAL 1 MONTH AS DATE) AS period, l_returnflag AS flag, l_linestatus AS status, round(avg(l_quantity), 6) AS value FROM lineitem GROUP BY ALL")
def sc5(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("period"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_quantity").alias("value"))
    made = load_macro(rows, "quantity", ["flag", "status"], "mean", lag=1)
    part = lambda k: F.get_json_object(F.regexp_extract("indicator", r"::(\{.*\})_lag", 1), f"$.{k}")
    return made.select("period", part("flag").alias("flag"), part("status").alias("status"), F.round("value", 6).alias("value"))


@register(BOOK, "ag1_sum_last", "SELECT l_suppkey, sum(l_quantity) AS total, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber)) AS latest FROM lineitem GROUP BY l_suppkey")
def ag1(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("total"), F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("latest"))


@register(BOOK, "ag2_pivot_wide", """WITH m AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_returnflag, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ALL)
SELECT period, sum(q) FILTER (l_returnflag = 'A') AS "A", sum(q) FILTER (l_returnflag = 'N') AS "N", sum(q) FILTER (l_returnflag = 'R') AS "R"
FROM (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM m) LEFT JOIN m USING (period) GROUP BY period""")
def ag2(spark, sf):
    long = table(spark, sf, "lineitem").groupBy(month_start(F.col("l_shipdate")).alias("period"), F.col("l_returnflag").alias("indicator")).agg(F.round(F.sum("l_quantity"), 2).alias("value"))
    return wide(long, ["A", "N", "R"])


@register(BOOK, "ag2_unpivot", "SELECT l_orderkey, l_linenumber, 'l_tax' AS name, l_tax AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', l_discount FROM lineitem")
def ag2b(spark, sf):
    return table(spark, sf, "lineitem").unpivot(["l_orderkey", "l_linenumber"], ["l_tax", "l_discount"], "name", "value")


@register(BOOK, "sc4_ag3_complete_sums", """SELECT mo, period, CASE WHEN count(v) = 3 THEN round(sum(v), 2) END AS y FROM (
  SELECT n_name AS mo, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderstatus AS category, sum(o_totalprice) AS v
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus IN ('F', 'O', 'P') GROUP BY ALL) GROUP BY mo, period""")
def ag3(spark, sf):
    from monthgrid.sources.files import load_target

    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    n = o.join(F.broadcast(table(spark, sf, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = n.groupBy(F.col("n_name").alias("mo"), month_start(F.col("o_orderdate")).alias("period"), F.col("o_orderstatus").alias("category")).agg(F.sum("o_totalprice").alias("value"))
    return load_target(rows, ["F", "O", "P"]).withColumn("y", F.round("y", 2))


@register(BOOK, "ag4_group_statistics", "SELECT l_returnflag, quantile_cont(l_quantity, 0.5) AS median, round(avg(l_extendedprice), 4) AS mean, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag")
def ag4(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.percentile("l_quantity", F.lit(0.5)).alias("median"), F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.count(F.lit(1)).alias("n"), F.count_distinct("l_suppkey").alias("suppliers"), F.max("l_shipdate").alias("last"))


@register(BOOK, "ag19_duplicate_keys", "SELECT l_suppkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def ag19(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register(BOOK, "ag20_entity_levels", sql(OBSERVED, "SELECT mo, round(avg(y), 2) AS level FROM obs WHERE mo <> 'NATION_3' GROUP BY mo HAVING avg(y) > 0"))
def ag20(spark, sf):
    rows = observed(spark, sf)
    return subset.levels(rows, among=rows.filter("mo <> 'NATION_3'")).withColumn("level", F.round("level", 2))


@register(BOOK, "ag17_strata", """WITH e AS (SELECT c_custkey, avg(o_totalprice) AS level FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey),
q AS (SELECT quantile_cont(level, [0.25, 0.5, 0.75]) AS b FROM e)
SELECT c_custkey, CASE WHEN level <= b[1] THEN 0 WHEN level <= b[2] THEN 1 WHEN level <= b[3] THEN 2 ELSE 3 END AS stratum FROM e, q""")
def ag17(spark, sf):
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return subset.strata(subset.levels(rows, "o_totalprice", "c_custkey"), entity="c_custkey").select("c_custkey", "stratum")


@register(BOOK, "ag17_rank_strata", """WITH e AS (SELECT o_custkey AS c_custkey, CASE WHEN count(*) > 40 THEN 2 ELSE 1 END AS level FROM orders GROUP BY o_custkey), k AS (SELECT *, row_number() OVER (ORDER BY level, c_custkey) AS k, count(*) OVER () AS n FROM e)
SELECT c_custkey, CAST(k > 1 + (n - 1) * 0.25 AS INTEGER) + CAST(k > 1 + (n - 1) * 0.5 AS INTEGER) + CAST(k > 1 + (n - 1) * 0.75 AS INTEGER) AS stratum FROM k""")
def ag17c(spark, sf):
    """Two levels only: strata are of equal rank."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
    rows = n.select("c_custkey", F.when(F.col("n") > 40, 2.0).otherwise(1.0).alias("level"))
    return subset.strata(rows, entity="c_custkey").select("c_custkey", "stratum")


@register(BOOK, "ag17_stratified_sample")
def ag17b(spark, sf):
    """A sampling operator: forty entities, evenly from the strata, in the order of a seeded hash."""
    return subset.draw(ag17(spark, sf), subset.even_sizes(40, 4), entity="c_custkey")


@register(BOOK, "sc18_roster", "SELECT DISTINCT trim(n_name) AS mo FROM nation")
def sc18(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("mo"))
    return roster(names, names.distinct().count())


@register(BOOK, "sc8_coverage", "SELECT min(CAST(ts AS DATE)) AS first, max(CAST(ts AS DATE)) AS last FROM events")
def sc8(spark, sf):
    return coverage(table(spark, sf, "events").select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts")), "ts")


@register(BOOK, "sc9_category_history", """WITH h AS (SELECT CAST(date_trunc('month', ts) AS DATE) AS period, avg(value) AS y FROM events WHERE event_type = (SELECT min(event_type) FROM events) GROUP BY ALL)
SELECT period, round(y, 6) AS y, round(coalesce(avg(y) OVER (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), y), 6) AS prediction FROM h""")
def sc9(spark, sf):
    rows = table(spark, sf, "events").select(F.col("ts").alias("period"), "event_type", "value")
    out = category_history(rows, "event_type", rows.agg(F.min("event_type")).first()[0])
    return out.select("period", F.round("y", 6).alias("y"), F.round("prediction", 6).alias("prediction"))


@register(BOOK, "sc20_news_table", "SELECT CAST(date_trunc('month', ts) AS DATE) AS period, count(*) AS news_volume, round(avg(value), 6) AS news_shock_score FROM events GROUP BY ALL")
def sc20(spark, sf):
    last = F.max(F.to_date("ts")).alias("period")
    monthly = table(spark, sf, "events").groupBy(F.trunc("ts", "month").alias("m")).agg(last, F.count(F.lit(1)).alias("telegram_volume"), F.round(F.avg("value"), 6).alias("telegram_shock_score"))
    return news_table(monthly.drop("m"))


@register(BOOK, "sc3_statistical_rows", "SELECT l_orderkey AS id, CAST(l_shipdate AS DATE) AS period, l_quantity * pow(10, l_linenumber % 4) AS value, l_returnflag AS unit FROM lineitem WHERE l_linestatus = 'F'")
def sc3(spark, sf):
    from monthgrid.sources.files import statistical_rows

    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("id"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("period"), F.concat(F.lit(" "), F.col("l_quantity").cast("string")).alias("value"),
        F.when(F.col("l_linestatus") == "F", "A").otherwise("B").alias("obs_status"), (F.col("l_linenumber") % 4).cast("string").alias("unit_mult"), F.col("l_returnflag").alias("unit_measure"),
    )
    return statistical_rows(raw).select(F.col("id").cast("bigint").alias("id"), "period", "value", "unit")
