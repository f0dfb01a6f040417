"""Queries of the text, place, URL and date scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from monthgrid.functions import text as tx
from monthgrid.functions.numbers import messy_number
from monthgrid.plans.book import register
from monthgrid.session import dealt, table

BOOK: dict = {}


PERIOD = "CAST(date_trunc('month', o_orderdate + INTERVAL 20 YEAR) AS DATE)"
FORMS = ["named", "short", "inside", "spaced", "compact", "dotted"]


@register(BOOK, "sf5_period_parser", f"""SELECT o_orderkey, {', '.join(f'{PERIOD} AS {n}' for n in FORMS)}, CAST(date_trunc('year', o_orderdate + INTERVAL 20 YEAR) AS DATE) AS year_only,
 CAST(date_trunc('month', o_orderdate) AS DATE) AS day_first, CAST(NULL AS DATE) AS name_after, CAST(NULL AS DATE) AS in_a_word, CAST(NULL AS DATE) AS decade, CAST(NULL AS DATE) AS old, CAST(NULL AS DATE) AS junk FROM orders""")
def sf5(spark, sf):
    now = F.col("o_orderdate")
    d = F.add_months(now.cast("date"), 240)
    names = ["январь", "Февраль", "март", "апрель", "май", "июнь", "июль", "август", "сентябрь", "октябрь", "ноябрь", "декабрь"]
    shorts = ["янв.", "фев", "марта", "апр", "май,", "июнь", "июль", "августа", "Сентябрь", "октябрь", "ноябрь", "декабрь"]
    pick = lambda words: F.array(*map(F.lit, words))[F.month(d) - 1]
    year = F.year(d).cast("string")
    made = {
        "named": F.concat(pick(names), F.lit(" "), year, F.lit(" года")), "short": F.concat(F.lit("за "), pick(shorts), F.lit(" "), year),
        "inside": F.concat(F.lit("период "), F.date_format(d, "yyyy-MM"), F.lit(" (факт)")), "spaced": F.date_format(d, "yyyy' m 'MM"),
        "compact": F.date_format(d, "yyyy'M'MM"), "dotted": F.date_format(d, "MM.yyyy"), "year_only": F.date_format(d, "yyyy' год'"),
        "day_first": F.date_format(now, "dd.MM.yyyy"), "name_after": F.concat(year, F.lit(" "), pick(names)), "in_a_word": F.concat(F.lit("маркет маяк "), year),
        "decade": F.concat(F.lit("Доля декады "), year), "old": F.concat(pick(names), F.lit(" 1920")), "junk": F.col("o_orderpriority"),
    }
    rows = dealt(table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), "o_orderkey")
    return rows.select("o_orderkey", *[tx.parse_period(c).alias(n) for n, c in made.items()])


@register(BOOK, "sf6_messy_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN NULL ELSE round(l_extendedprice, 2) END AS price, CAST(l_linenumber AS DOUBLE) * 1000 AS scientific FROM lineitem")
def sf6(spark, sf):
    shown = F.regexp_replace(F.format_number(F.round("l_extendedprice", 2), 2), ",", " ")
    raw = F.when(F.col("l_linenumber") == 1, "..").otherwise(F.concat(F.lit(" "), F.regexp_replace(shown, r"\.", ","), F.lit(" руб")))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", messy_number(raw).alias("price"), messy_number(F.concat("l_linenumber", F.lit(",0 E+3 шт"))).alias("scientific"))


@register(BOOK, "sf9_geo_key", "SELECT n_nationkey, lower(regexp_replace(r_name, '_+', ' ', 'g')) || ' факт::' || CASE WHEN n_nationkey % 2 = 0 THEN 'район ' ELSE '' END || lower(n_name) || ' 3' AS key FROM nation JOIN region ON n_regionkey = r_regionkey")
def sf9(spark, sf):
    n = table(spark, sf, "nation").join(F.broadcast(table(spark, sf, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    region = F.concat(F.lit("Республика "), F.replace("r_name", F.lit("_"), F.lit("  ")), F.lit(" (факт)"))
    name = F.concat(F.when(F.col("n_nationkey") % 2 == 0, "район ").otherwise("г. "), F.col("n_name"), F.lit("\u00a0[3] *"))
    return n.select("n_nationkey", tx.geo_key(region, name).alias("key"))


#: The references that the pages hold; the operator knows all of HTML's.
SHOWN = {"&quot;": '"', "&copy;": "©", "&middot;": "·"}


def unescaped_sql(column: str) -> str:
    for entity, char in SHOWN.items():
        column = f"replace({column}, '{entity}', '{char}')"
    return f"regexp_replace({column}, '&amp;?', '&', 'g')"


HTML = r"substr(trim(regexp_replace(regexp_replace(regexp_replace(" + unescaped_sql("html") + r""", '<[^>]+>', ' ', 'g'), '(?i)(?:https?://|www\.)\S+', ' ', 'g'), '[ \x{00A0}\t\n\r\f\v]+', ' ', 'g')), 1, 2000)"""


@register(BOOK, "sf10_clean_text", f"SELECT page_id, {HTML} AS body FROM pages")
def sf10(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.clean_text(F.col("html")).alias("body"))


@register(BOOK, "sf11_normal_url", r"SELECT page_id, lower(regexp_extract(url, '^(https?)://([^/?#\s]+)([^?#\s]*)', 1)) || '://' || lower(regexp_extract(url, '^(https?)://([^/?#\s]+)([^?#\s]*)', 2)) || regexp_extract(url, '^(https?)://([^/?#\s]+)([^?#\s]*)', 3) AS url FROM pages WHERE regexp_matches(url, '^https?://[^/?#\s]+')")
def sf11(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.normal_url(F.col("url")).alias("url")).filter("url is not null")


@register(BOOK, "sf12_parse_when", "SELECT event_id, date_trunc('second', ts) + INTERVAL 3 HOUR AS from_ms, date_trunc('second', ts) + INTERVAL 3 HOUR AS from_iso, date_trunc('second', ts) AS local FROM events")
def sf12(spark, sf):
    t = F.date_trunc("second", "ts").cast("timestamp")
    ms = (F.unix_seconds(t) * 1000).cast("string")
    iso = F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = table(spark, sf, "events").select("event_id", *[tx.parse_when(c).alias(n) for n, c in (("from_ms", ms), ("from_iso", iso), ("local", F.date_format(t, "yyyy-MM-dd HH:mm:ss")))])
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("from_ms", "from_iso", "local")})


@register(BOOK, "sf16_topics", "SELECT doc_id, lang = 'en' OR source IN ('src1', 'src2') AS economic FROM documents")
def sf16(spark, sf):
    tags = F.concat(F.lit("x; "), F.upper("source"), F.lit(" | y"))
    return table(spark, sf, "documents").select("doc_id", tx.has_topic(F.col("lang"), tags, ["EN", "src1", "src2"]).alias("economic"))


@register(BOOK, "sf18_digests", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def sf18(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"))


@register(BOOK, "sf19_dimension_key", "SELECT DISTINCT 'm::{\"flag\":\"' || l_returnflag || '\",\"status\":\"' || l_linestatus || '\"}' AS indicator FROM lineitem")
def sf19(spark, sf):
    from monthgrid.sources.files import indicator_key

    rows = table(spark, sf, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_returnflag").alias("flag"))
    return rows.select(indicator_key("m", ["status", "flag"]).alias("indicator")).distinct()
