"""The panel queries over many entities: monthly line-item value of each supplier, even and odd lines apart (2,000 at scale 0.1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.functions.calendar import month_start
from monthgrid.operators import detect, forecast
from monthgrid.operators import windows as wn
from monthgrid.operators.panel import regularize
from monthgrid.plans.book import register
from monthgrid.plans.panels import FEATURES, ROUNDED, r
from monthgrid.session import table

BOOK: dict = {}
LINES = """WITH obs AS (
  SELECT CAST(l_suppkey AS VARCHAR) || '/' || CAST(l_linenumber % 2 AS VARCHAR) AS mo, CAST(date_trunc('month', l_shipdate) AS DATE) AS period, round(sum(l_extendedprice), 2) AS y FROM lineitem GROUP BY ALL),
cal AS ("""


def lines(spark, sf) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_linenumber", "l_shipdate", "l_extendedprice")
    mo = F.concat(F.col("l_suppkey").cast("string"), F.lit("/"), (F.col("l_linenumber") % 2).cast("string"))
    return rows.groupBy(mo.alias("mo"), month_start(F.col("l_shipdate")).alias("period")).agg(F.round(F.sum("l_extendedprice"), 2).alias("y"))


@register(BOOK, "wn1_many_entities", LINES + FEATURES.split("cal AS (", 1)[1].replace(", 7)", ", 4)"))
def features(spark, sf):
    return r(wn.features(regularize(lines(spark, sf))), **{c: min(n, 4) if n == 7 else n for c, n in ROUNDED.items()})


@register(BOOK, "ts13_many_trends")
def trends(spark, sf):
    rows = lines(spark, sf)
    return r(forecast.trend_arm(rows.filter(F.col("period") < "2001-01-01"), rows.filter(F.col("period") >= "2001-01-01")), pred=2)


@register(BOOK, "ts2_many_entities")
def alarms(spark, sf):
    return r(detect.cusum(lines(spark, sf)), cusum_score=5)


@register(BOOK, "ts5_many_entities")
def breaks(spark, sf):
    return r(detect.segmentation(lines(spark, sf), "pelt"), pelt_score=6)
