"""Queries over the panel: calendar, windows, projections and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.functions.calendar import month_index, month_start, season, shift
from monthgrid.functions.names import without_prefixes
from monthgrid.functions.numbers import at_least, growth, narrowest, number, ratio
from monthgrid.operators import subset
from monthgrid.operators import windows as wn
from monthgrid.operators.joins import keep_last
from monthgrid.operators.panel import calendar, direct, nation_panel, regularize
from monthgrid.plans.book import MONTH, OBSERVED, PANEL, register, sql
from monthgrid.session import table
from monthgrid.sources.files import load_target

BOOK: dict = {}


def observed(spark: SparkSession, sf: str) -> DataFrame:
    return nation_panel(spark, sf)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return regularize(nation_panel(spark, sf))


def r(df: DataFrame, **digits: int) -> DataFrame:
    """Columns rounded, so that two engines' last bits don't show."""
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


P3, P12 = "ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING", "ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING"
FULL = {n: {c: f"CASE WHEN count(y) OVER p{n} = {n} THEN {f}(y) OVER p{n} END" for c, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))} for n in (3, 12)}
OVER = f"WINDOW w AS (PARTITION BY mo ORDER BY period), p3 AS (PARTITION BY mo ORDER BY period {P3}), p12 AS (PARTITION BY mo ORDER BY period {P12}), pa AS (PARTITION BY mo ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
FEATURES = sql(PANEL, f"""SELECT mo, period, y, y_lag_1, y_lag_2, y_lag_3, y_lag_12,
  round(y_lag_1 / nullif(y_lag_2, 0) - 1, 6) AS y_growth_mom, round(y_lag_1 / nullif(y_lag_13, 0) - 1, 6) AS y_growth_yoy,
  {", ".join(f"{'round(' if c in ('mean', 'std') else ''}y_{c}_{n}{', 7)' if c in ('mean', 'std') else ''} AS y_{c}_{n}" for n in (3, 12) for c in ("mean", "std", "min", "max"))},
  round(spending_volatility, 6) AS spending_volatility
FROM (SELECT *, lag(y, 1) OVER w AS y_lag_1, lag(y, 2) OVER w AS y_lag_2, lag(y, 3) OVER w AS y_lag_3, lag(y, 12) OVER w AS y_lag_12, lag(y, 13) OVER w AS y_lag_13,
  {", ".join(f"{FULL[n][c]} AS y_{c}_{n}" for n in (3, 12) for c in ("mean", "std", "min", "max"))},
  CASE WHEN count(y) OVER pa >= 2 THEN stddev_samp(y) OVER pa / nullif(abs(avg(y) OVER pa), 0) END AS spending_volatility,
  row_number() OVER w - 1 AS age FROM panel {OVER})
WHERE age >= 12 AND y IS NOT NULL""")
ROUNDED = {"y_growth_mom": 6, "y_growth_yoy": 6, "y_mean_3": 7, "y_std_3": 7, "y_mean_12": 7, "y_std_12": 7, "spending_volatility": 6}


@register(BOOK, "wn1_wn5_causal_features", FEATURES)
def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Monthly order value of each nation, gap-filled, with lags, growth, rolling statistics and volatility."""
    return r(wn.features(panel(spark, sf)), **ROUNDED)


@register(BOOK, "sf3_regularize", sql(PANEL, "SELECT mo, period, y FROM panel"))
def sf3(spark, sf):
    return panel(spark, sf)


@register(BOOK, "sf3_calendar", sql(PANEL, "SELECT mo, period FROM cal"))
def sf3b(spark, sf):
    return calendar(observed(spark, sf))


@register(BOOK, "sf1_sf2_month_arithmetic", f"SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS month, CAST(date_trunc('month', o_orderdate) + INTERVAL 7 MONTH AS DATE) AS month_after, CAST({MONTH.format('o_orderdate')} - {MONTH.format(chr(68) + 'ATE ' + chr(39) + '1995-01-01' + chr(39))} AS INTEGER) AS distance FROM orders")
def sf12(spark, sf):
    m = month_start(F.col("o_orderdate"))
    return table(spark, sf, "orders").select("o_orderkey", m.alias("month"), shift(m, 7).alias("month_after"), (month_index(m) - month_index(F.lit("1995-01-01").cast("date"))).alias("distance"))


@register(BOOK, "sf4_season", sql(PANEL, "SELECT mo, period, CAST(month(period) AS INTEGER) AS month, CAST(quarter(period) AS INTEGER) AS quarter, round(sin(2 * pi() * (month(period) - 1) / 12), 9) + 0.0 AS month_sin, round(cos(2 * pi() * (month(period) - 1) / 12), 9) + 0.0 AS month_cos FROM panel"))
def sf4(spark, sf):
    s = season(F.col("period"))
    return panel(spark, sf).select("mo", "period", s["month"].alias("month"), s["quarter"].alias("quarter"), (F.round(s["month_sin"], 9) + 0.0).alias("month_sin"), (F.round(s["month_cos"], 9) + 0.0).alias("month_cos"))


@register(BOOK, "sf17_math", "SELECT l_orderkey, l_linenumber, round(ln(1 + l_quantity), 9) AS log1p, round(exp(l_discount) - 1, 9) AS expm1, pow(10.0, l_linenumber) AS pow10, round(sqrt(l_tax), 9) AS root, abs(l_discount - l_tax) AS gap, CAST(sign(l_discount - l_tax) AS DOUBLE) AS side FROM lineitem")
def sf17(spark, sf):
    gap = F.col("l_discount") - F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.log1p("l_quantity"), 9).alias("log1p"), F.round(F.expm1("l_discount"), 9).alias("expm1"),
        F.pow(F.lit(10.0), F.col("l_linenumber")).alias("pow10"), F.round(F.sqrt("l_tax"), 9).alias("root"), F.abs(gap).alias("gap"), F.signum(gap).alias("side"),
    )


@register(BOOK, "sc6_pf1_pruned_scan", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000 AND o_orderdate IS NOT NULL")
def sc6(spark, sf):
    keep = (F.col("o_orderstatus") == "F") & F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(1000, 200000) & F.col("o_orderdate").isNotNull()
    return table(spark, sf, "orders").filter(keep).select("o_orderkey", "o_totalprice")


@register(BOOK, "pf2_rename_reorder", "SELECT n_name AS entity, n_nationkey AS id FROM nation")
def pf2(spark, sf):
    return table(spark, sf, "nation").withColumnsRenamed({"n_name": "entity", "n_nationkey": "id"}).drop("n_regionkey").select("entity", "id")


@register(BOOK, "pf3_coercion", "SELECT event_id, TRY_CAST(nullif(regexp_extract(event_type, '(\\d+)', 1), '') AS DOUBLE) AS from_type, TRY_CAST(CAST(value AS VARCHAR) AS DOUBLE) AS from_value, CAST(NULL AS DOUBLE) AS from_nan FROM events")
def pf3(spark, sf):
    digits = F.nullif(F.regexp_extract("event_type", r"(\d+)", 1), F.lit(""))
    nan = F.when(F.col("event_id") % 2 == 0, "NaN").otherwise("Infinity")
    return table(spark, sf, "events").select("event_id", number(digits).alias("from_type"), number(F.col("value").cast("string")).alias("from_value"), number(nan).alias("from_nan"))


@register(BOOK, "pf4_pf7_pf8_guards", sql(PANEL, "SELECT mo, period, CASE WHEN y IS NOT NULL THEN greatest(y - 500000, 0.000001) END AS floored, round((y / nullif(y - y, 0)), 6) AS by_zero, round(1e6 / nullif(y, 0), 6) AS per_million FROM panel"))
def pf8(spark, sf):
    y = F.col("y")
    return panel(spark, sf).select("mo", "period", at_least(y - 500000, 1e-6).alias("floored"), ratio(y, y - y).alias("by_zero"), F.round(ratio(F.lit(1e6), y), 6).alias("per_million"))


@register(BOOK, "pf6_without_news", "SELECT o_orderkey, o_totalprice FROM orders")
def pf6(spark, sf):
    return without_prefixes(table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.lit(1.0).alias("news_volume"), F.lit(0.0).alias("telegram_shock")))


@register(BOOK, "pf9_downcast", "SELECT l_orderkey, l_linenumber, CAST(l_linenumber AS TINYINT) AS line, CAST(CAST(l_discount AS FLOAT) AS DOUBLE) AS discount FROM lineitem")
def pf9(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount")
    lo, hi = rows.agg(F.min("l_linenumber"), F.max("l_linenumber")).first()
    return rows.select("l_orderkey", "l_linenumber", F.col("l_linenumber").cast(narrowest(F.col("l_linenumber"), lo or 0, hi or 0)).alias("line"), F.col("l_discount").cast("float").cast("double").alias("discount"))


@register(BOOK, "pf10_anchors", "SELECT anchor, n_name AS mo FROM nation JOIN (VALUES ('first', 'Nation_24'), ('second', 'ION_17')) AS a(anchor, part) ON contains(lower(n_name), lower(part))")
def pf10(spark, sf):
    return subset.anchors(table(spark, sf, "nation").select(F.col("n_name").alias("mo")), {"first": "Nation_24", "second": "ION_17"})


@register(BOOK, "wn6_zscore", sql(PANEL, f"SELECT mo, period, round(CASE WHEN count(y) OVER p12 >= 4 THEN (y - avg(y) OVER p12) / greatest(stddev_samp(y) OVER p12, 1e-8) END, 6) AS z FROM panel {OVER}"))
def wn6(spark, sf):
    return panel(spark, sf).select("mo", "period", F.round(wn.zscore("y", 12, wn.by(), 4), 6).alias("z"))


@register(BOOK, "wn8_rolling_quantile", sql(PANEL, f"SELECT mo, period, round(CASE WHEN count(y) OVER p12 >= 4 THEN quantile_cont(y, 0.9) OVER p12 END, 5) AS q90 FROM panel {OVER}"))
def wn8(spark, sf):
    return panel(spark, sf).select("mo", "period", F.round(wn.quantile("y", 0.9, wn.past(wn.by(), 12), 4), 5).alias("q90"))


GAPPY = PANEL + ", gappy AS (SELECT mo, period, CASE WHEN month(period) % 5 > 2 THEN NULL ELSE y END AS v FROM panel)"


def gappy(spark, sf):
    return panel(spark, sf).select("mo", "period", F.when(F.month("period") % 5 <= 2, F.col("y")).alias("v"))


@register(BOOK, "wn12_limited_fill", sql(GAPPY, "SELECT mo, period, last_value(v IGNORE NULLS) OVER (PARTITION BY mo ORDER BY period ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM gappy"))
def wn12(spark, sf):
    return gappy(spark, sf).select("mo", "period", wn.filled("v", wn.by(), 2).alias("v"))


@register(BOOK, "wn14_pct_change_12", sql(OBSERVED, "SELECT mo, period, round(y / nullif(lag(y, 12) OVER (PARTITION BY mo ORDER BY period), 0) - 1, 6) AS change FROM obs"))
def wn14(spark, sf):
    return observed(spark, sf).select("mo", "period", F.round(growth(F.col("y"), F.lag("y", 12).over(wn.by())), 6).alias("change"))


@register(BOOK, "wn15_proxy", sql(PANEL, f"SELECT mo, period, round(avg(y) OVER pa, 7) AS level, round(lag(y, 1) OVER w / nullif(lag(y, 2) OVER w, 0) - 1, 6) AS change FROM panel {OVER}"))
def wn15(spark, sf):
    w = wn.by()
    return panel(spark, sf).select("mo", "period", F.round(F.avg("y").over(wn.all_past(w)), 7).alias("level"), F.round(growth(F.lag("y", 1).over(w), F.lag("y", 2).over(w)), 6).alias("change"))


@register(BOOK, "wn16_islands", sql(GAPPY, f"SELECT mo, min(period) AS first, max(period) AS last, count(*) AS months FROM (SELECT *, {MONTH.format('period')} - row_number() OVER (PARTITION BY mo ORDER BY period) AS g FROM gappy WHERE v IS NOT NULL) GROUP BY mo, g"))
def wn16(spark, sf):
    rows = gappy(spark, sf).filter("v is not null").withColumn("g", wn.run_of("period", wn.by()))
    return rows.groupBy("mo", "g").agg(F.min("period").alias("first"), F.max("period").alias("last"), F.count(F.lit(1)).alias("months")).drop("g")


@register(BOOK, "wn17_national_baseline", sql(OBSERVED, f"SELECT period, y, round(coalesce(avg(y) OVER (ORDER BY period {P3}), y), 7) AS prediction FROM (SELECT period, round(sum(y), 2) AS y FROM obs GROUP BY period)"))
def wn17(spark, sf):
    """The window is over months of one national series."""
    rows = observed(spark, sf).groupBy("period").agg(F.round(F.sum("y"), 2).alias("y"))
    return rows.select("period", "y", F.round(F.coalesce(F.avg("y").over(W.orderBy("period").rowsBetween(-3, -1)), F.col("y")), 7).alias("prediction"))


@register(BOOK, "wn20_last_rows", sql(OBSERVED, "SELECT mo, period, y FROM obs QUALIFY row_number() OVER (PARTITION BY mo ORDER BY period DESC) <= 3"))
def wn20(spark, sf):
    return wn.last_rows(observed(spark, sf), 3)


@register(BOOK, "wn11_duplicate_slots", "WITH x AS (SELECT CAST(l_suppkey AS VARCHAR) AS mo, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, l_quantity AS v, row_number() OVER (PARTITION BY l_suppkey, date_trunc('month', l_shipdate) ORDER BY l_orderkey, l_linenumber) AS s FROM lineitem WHERE l_linestatus = 'F') SELECT CASE WHEN s > 1 THEN mo || ' #' || CAST(s AS VARCHAR) ELSE mo END AS mo, period, v AS y FROM x")
def wn11(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("mo"), F.col("l_shipdate").cast("date").alias("period"), F.col("l_linestatus").alias("category"), F.col("l_quantity").alias("value"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("place"))
    return load_target(rows, ["F"], ordinal="place")


@register(BOOK, "ts18_direct_panel", sql(PANEL, "SELECT a.mo, a.period AS origin, CAST(a.period + INTERVAL 3 MONTH AS DATE) AS target_end, a.y, b.y AS target, 3 AS lead_months FROM panel a JOIN panel b ON a.mo = b.mo AND b.period = a.period + INTERVAL 3 MONTH WHERE b.y IS NOT NULL"))
def ts18(spark, sf):
    return direct(panel(spark, sf), 3).select("mo", "origin", "target_end", "y", "target", "lead_months")


@register(BOOK, "so1_so3_top_entities", sql(OBSERVED, "SELECT mo, period, y FROM (SELECT *, dense_rank() OVER (ORDER BY total DESC, mo) AS k FROM (SELECT *, round(sum(y) OVER (PARTITION BY mo), 0) AS total FROM obs)) WHERE k <= 5 ORDER BY mo, period"))
def so3(spark, sf):
    """A top-k report: the five entities with the largest totals."""
    rows = observed(spark, sf)
    top = rows.groupBy("mo").agg(F.round(F.sum("y"), 0).alias("total")).orderBy(F.desc("total"), "mo").limit(5)
    return rows.join(F.broadcast(top.select("mo")), "mo", "left_semi").select("mo", "period", "y").orderBy("mo", "period")


@register(BOOK, "so2_row_ids_kept", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS place FROM orders ORDER BY o_orderkey")
def so2(spark, sf):
    w = W.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf, "orders").select("o_orderkey", F.row_number().over(w).alias("place")).orderBy("o_orderkey")


@register(BOOK, "so4_union_widened", "SELECT s_suppkey AS key, s_name AS name, s_acctbal AS balance, NULL AS segment FROM supplier UNION ALL SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def so4(spark, sf):
    s = table(spark, sf, "supplier").selectExpr("s_suppkey as key", "s_name as name", "s_acctbal as balance")
    c = table(spark, sf, "customer").selectExpr("c_custkey as key", "c_name as name", "c_acctbal as balance", "c_mktsegment as segment")
    return s.unionByName(c, allowMissingColumns=True)


@register(BOOK, "so5_keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def so5(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderkey", "o_totalprice")
    return keep_last(rows, ["o_custkey"], "o_orderdate", "o_orderkey").drop("o_orderdate")


@register(BOOK, "so6_key_sets", "SELECT 'both' AS part, n_nationkey AS key FROM (SELECT c_nationkey AS n_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'customers_only', c_nationkey FROM (SELECT c_nationkey FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'any', c_nationkey FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)")
def so6(spark, sf):
    c = table(spark, sf, "customer").selectExpr("c_nationkey as key")
    s = table(spark, sf, "supplier").selectExpr("s_nationkey as key")
    named = lambda df, n: df.select(F.lit(n).alias("part"), "key")
    return named(c.intersect(s), "both").union(named(c.distinct().exceptAll(s.distinct()), "customers_only")).union(named(c.union(s).distinct(), "any"))
