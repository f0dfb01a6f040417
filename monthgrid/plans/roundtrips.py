"""Queries that write a table in a format of the sources and read it back by them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from monthgrid.plans.book import register
from monthgrid.session import shared_dir, table
from monthgrid.sources import files, sinks

BOOK: dict = {}


def place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@register(BOOK, "sc2_strict_csv", "SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, o_orderstatus, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def sc2(spark, sf):
    path = place(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_custkey").write.option("sep", ";").option("header", True).csv(path)
    return files.strict_csv(spark, path)


@register(BOOK, "sc7_news_csv", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents")
def sc7(spark, sf):
    path = place(spark, "news-csv")
    quoted = table(spark, sf, "documents").select("doc_id", "text", "source")
    quoted.write.option("header", True).option("quoteAll", True).option("escape", '"').option("multiLine", True).csv(path)
    return files.news_csv(spark, path, ["doc_id", "text"])


@register(BOOK, "sc11_sc15_json_records", "SELECT page_id, url FROM pages")
def sc11(spark, sf):
    path = place(spark, "json")
    rows = table(spark, sf, "pages").select("page_id", "url")
    # Each file is one mapping whose container key holds the records of a group of pages.
    grouped = rows.groupBy((F.col("page_id") % 8).alias("g")).agg(F.collect_list(F.struct("page_id", "url")).alias("items"))
    grouped.select(F.to_json(F.struct("items")).alias("value")).repartition(8, "value").write.option("maxRecordsPerFile", 1).text(path)
    got = files.news_json(spark, [f"{path}/part-*"])
    return got.select(F.get_json_object("record", "$.page_id").cast("bigint").alias("page_id"), F.get_json_object("record", "$.url").alias("url"))


@register(BOOK, "sk1_sk3_partitioned_parquet", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_returnflag = 'R'")
def sk1(spark, sf):
    """What is read back is pruned to one partition."""
    path = place(spark, "parquet")
    sinks.write_with_manifest(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"), path, ["lineitem"], partition_by=["l_returnflag"])
    return spark.read.parquet(path).filter("l_returnflag = 'R'")


@register(BOOK, "sc1_sc12_discovered_files", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS part FROM customer")
def sc1(spark, sf):
    """One table is found by its name's pattern, the other by tokens of its files' names."""
    folder = place(spark, "exports")
    rows = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    rows.filter("c_custkey % 2 = 0").write.option("sep", ";").option("header", True).csv(f"{folder}/customers_even_2024.csv")
    rows.filter("c_custkey % 2 <> 0").write.option("sep", ";").option("header", True).csv(f"{folder}/deep/odd")
    even = files.strict_csv(spark, files.discover(spark, folder, "customers_*_2024.csv"))
    odd = spark.read.option("sep", ";").option("header", True).csv(files.discover_tokens(spark, f"{folder}/deep", ["PART"]))
    return even.withColumn("part", F.lit("even")).unionByName(odd.withColumn("part", F.lit("odd")))


@register(BOOK, "sc10_json_discovery", "SELECT page_id, url FROM pages WHERE page_id % 2 = 0")
def sc10(spark, sf):
    """Of a configured export that isn't there and a known one that is, the known one is read."""
    root = place(spark, "roots")
    rows = table(spark, sf, "pages").filter("page_id % 2 = 0").select("page_id", "url")
    rows.write.json(f"{root}/data/rbk.json")
    found, _ = files.find_json(spark, ["data/gone.json"], [root, f"{root}/data"])
    return spark.read.schema("page_id bigint, url string").json(found)


@register(BOOK, "sk6_cached_table", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def sk6(spark, sf):
    """Built once under the fingerprint of its source, then read."""
    path, source = place(spark, "cache"), f"{sf}/orders.parquet"
    key = sinks.fingerprint(spark, {"by": "o_orderstatus"}, [source])
    build = lambda: table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    sinks.cached(spark, path, key, build)
    return sinks.cached(spark, path, key, lambda: 1 / 0)


KNOWN = "avg(CASE WHEN {0} IS NOT NULL AND trim(CAST({0} AS VARCHAR)) <> '' THEN CAST({1} AS DOUBLE) END)"


@register(BOOK, "sf8_column_roles", f"""WITH s AS (SELECT {KNOWN.format('o_orderdate', "regexp_matches(CAST(o_orderdate AS VARCHAR), '^[0-9]+-')")} AS d, {KNOWN.format('o_totalprice', 'try_cast(o_totalprice AS DOUBLE) IS NOT NULL')} AS p, {KNOWN.format('o_orderpriority', "try_cast(o_orderpriority AS DOUBLE) IS NOT NULL")} AS e FROM orders)
SELECT unnest(['o_orderdate', 'o_totalprice', 'o_orderpriority']) AS name, unnest([CASE WHEN d >= 0.5 THEN 'date' END, CASE WHEN p >= 0.5 THEN 'number' END, CASE WHEN e < 0.5 THEN 'entity' END]) AS role FROM s""")
def sf8(spark, sf):
    """Roles of the columns of an untyped table, told from all of its values."""
    o = table(spark, sf, "orders")
    shown = o.select(F.date_format("o_orderdate", "yyyy-MM").alias("o_orderdate"), F.col("o_totalprice").cast("string").alias("o_totalprice"), F.regexp_replace("o_orderpriority", "[0-9]-", "").alias("o_orderpriority"))
    return spark.createDataFrame(list(files.role_of_columns(shown).items()), "name string, role string")


@register(BOOK, "pf5_first_column", "SELECT o_orderkey, o_totalprice AS y FROM orders")
def pf5(spark, sf):
    """The first of several names that a table has."""
    from monthgrid.functions.names import first_column

    o = table(spark, sf, "orders")
    return o.select("o_orderkey", F.col(first_column(o, ["actual", "target", "o_totalprice", "o_custkey"])).alias("y"))
