"""Queries of the news operators: documents stand in for articles, with a month made from their id."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthgrid.operators import news
from monthgrid.plans.book import register
from monthgrid.plans.panels import r
from monthgrid.session import table

BOOK: dict = {}

RECORDS = """rec AS (SELECT doc_id, CAST(DATE '2022-01-01' + CAST(doc_id % 30 AS INTEGER) * INTERVAL 1 MONTH AS DATE) AS date, doc_id AS seq, source, CAST(doc_id % 700 AS VARCHAR) AS article_id, CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'u' || CAST(doc_id % 650 AS VARCHAR) END AS url, text FROM documents)"""


def records(spark, sf):
    i = F.col("doc_id")
    return table(spark, sf, "documents").select(
        "doc_id", F.add_months(F.lit("2022-01-01").cast("date"), (i % 30).cast("int")).alias("date"), i.alias("seq"), "source", (i % 700).cast("string").alias("article_id"),
        F.when(i % 5 == 0, "").otherwise(F.concat(F.lit("u"), (i % 650).cast("string"))).alias("url"), "text",
    )


@register(BOOK, "sf14_record_verdicts", "WITH " + RECORDS + " SELECT doc_id, CASE WHEN date IS NULL THEN 'no_date' WHEN text IS NULL OR text = '' THEN 'no_text' WHEN length(text) < 300 THEN 'short' WHEN NOT (contains(lower(text), 'the') OR contains(lower(text), 'und')) THEN 'no_keyword' END AS reason FROM rec")
def sf14(spark, sf):
    return news.verdicts(records(spark, sf), least=300, keywords=["the", "und"]).select("doc_id", "reason")


@register(BOOK, "sf14_reason_counts", "WITH " + RECORDS + " SELECT coalesce(CASE WHEN length(text) < 300 THEN 'short' END, 'accepted') AS reason, count(*) AS n FROM rec GROUP BY ALL")
def sf14b(spark, sf):
    return news.verdicts(records(spark, sf), least=300).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@register(BOOK, "sf15_three_way_dedup", "WITH " + RECORDS + r""" SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY source, article_id ORDER BY date, seq) AS a,
 CASE WHEN url = '' THEN 1 ELSE row_number() OVER (PARTITION BY url ORDER BY date, seq) END AS b, row_number() OVER (PARTITION BY lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) ORDER BY date, seq) AS c FROM rec) WHERE a = 1 AND b = 1 AND c = 1""")
def sf15(spark, sf):
    return news.dedup(records(spark, sf)).select("doc_id")


MONTHLY = RECORDS + """, sc AS (SELECT date AS period, (doc_id % 7) / 7.0 AS score FROM (SELECT doc_id, CAST(DATE '2022-01-01' + to_months(CAST(i + 2 * (i // 4) AS INTEGER)) AS DATE) AS date FROM (SELECT doc_id, (year(date) - 2022) * 12 + month(date) - 1 AS i FROM rec))),
c AS (SELECT period, avg(score) AS s, count(*) AS n FROM sc GROUP BY period),
mo AS (SELECT p.period, s AS sentiment_index, coalesce(n, 0) AS news_volume, ln(1 + coalesce(n, 0)) AS news_log_volume FROM (SELECT CAST(unnest(generate_series(min(period), max(period), INTERVAL 1 MONTH)) AS DATE) AS period FROM c) p LEFT JOIN c USING (period))"""


def months(spark, sf):
    i = (F.year("date") - 2022) * 12 + F.month("date") - 1  # two months without news after every fourth
    rows = records(spark, sf).select(F.add_months(F.lit("2022-01-01").cast("date"), (i + 2 * F.floor(i / 4)).cast("int")).alias("period"), ((F.col("doc_id") % 7) / 7.0).alias("score"))
    return news.monthly(rows)


@register(BOOK, "ag18_news_months", "WITH " + MONTHLY + " SELECT period, round(sentiment_index, 6) AS sentiment_index, news_volume, round(news_log_volume, 9) AS news_log_volume FROM mo")
def ag18(spark, sf):
    return r(months(spark, sf), sentiment_index=6, news_log_volume=9)


@register(BOOK, "wn7_news_shock", "WITH " + MONTHLY + """ SELECT period, round(CASE WHEN count(*) OVER w = 3 THEN news_volume - avg(news_volume) OVER w END, 6) AS news_shock_score,
 round(CASE WHEN count(*) OVER w = 3 AND stddev_samp(news_log_volume) OVER w > 1e-10 THEN (news_log_volume - avg(news_log_volume) OVER w) / stddev_samp(news_log_volume) OVER w ELSE 0.0 END, 5) AS news_shock_index
 FROM mo WINDOW w AS (ORDER BY period ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)""")
def wn7(spark, sf):
    return r(news.shock(months(spark, sf)).select("period", "news_shock_score", "news_shock_index"), news_shock_score=6, news_shock_index=5)


@register(BOOK, "pf12_news_intensity", "SELECT event_id, abs(value) AS intensity FROM events")
def pf12(spark, sf):
    return table(spark, sf, "events").select("event_id", F.abs(F.col("value").try_cast("double")).alias("intensity"))


@register(BOOK, "sf20_unique_scoring")
def sf20(spark, sf):
    """Quality of every text, learnt from the labels of two thirds of the documents; the rest is held out."""
    rows = records(spark, sf).select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    known = rows.filter(~held).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")
    return r(news.scored(rows, news.fit_scorer(known, "text", "quality")).select("doc_id", held.alias("held_out"), "score"), score=6)


@register(BOOK, "sf14_first_filled", "SELECT doc_id, CASE WHEN trim(coalesce(lang, '')) <> '' THEN trim(lang) WHEN trim(coalesce(source, '')) <> '' THEN trim(source) END AS shown FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN ' ' WHEN doc_id % 3 = 1 THEN NULL ELSE lang END AS lang, source FROM documents)")
def sf14c(spark, sf):
    """The first alias field of a record that isn't blank."""
    i = F.col("doc_id") % 3
    rows = table(spark, sf, "documents").select("doc_id", F.when(i == 0, " ").when(i == 2, F.col("lang")).alias("lang"), "source")
    return rows.select("doc_id", news.first_filled("lang", "source").alias("shown"))
