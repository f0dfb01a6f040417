"""URL filter lists joined as of the fetch date, in DataFrame functions only.

A dated entry (key, date, add or remove) becomes a validity interval: it holds from its date up to the next
entry of its key.  A key is a host or one of its parent domains (two labels or more); an IP address, with dots or in
brackets, has no parents.  The dot of the root domain is dropped from hosts and keys.  Every distinct host and
date of the captures is evaluated once against all its keys, by carrying the latest interval forward, and the
verdicts are joined back to the captures.  All grouped work is first reduced to distinct (key, date), so a key
that holds a third of the entries or captures has no more rows than there are dates.

Defined results: entries with a null or empty key or a null date are ignored; of one key's entries on one date, an add wins
over removals; an entry is in force on its own date; captures without a host or date are not blocked; very long addresses are keys like any other; repeated
captures each get a row; empty tables give no verdicts; other columns of the captures pass through, but for those
that have the names of the results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrowtools import spare

#: The host of a URL: an address in brackets, or what ends before a port or the path.
HOST_PATTERN = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?(\[[0-9a-fA-F:.]+\]|[^/?#:@\[\]]+)"
#: An address, which is one key.
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"


def host_of(url):
    """The lower-case host of a URL; NULL where there is none."""
    return plain_key(F.regexp_extract(url, HOST_PATTERN, 1))


def plain_key(key):
    """Lower-case, without the root domain's dot; NULL where nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(key), r"\.+$", ""), F.lit(""))


def keys_of(host):
    """A host and its parents of two labels or more; an address by itself."""
    labels = F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.split(host, r"\."))
    starts = F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1)))
    return F.transform(starts, lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def validity(entries: DataFrame, *, key: str = "key", date: str = "date", adds: str = "adds") -> DataFrame:
    """(key, valid_from, valid_to, adds): valid_to is the date of the key's next entry, or null."""
    daily = (
        entries.filter(plain_key(F.col(key)).isNotNull() & F.col(date).isNotNull())
        .groupBy(plain_key(F.col(key)).alias("key"), F.col(date).cast("date").alias("valid_from"))
        .agg(F.max(F.coalesce(F.col(adds), F.lit(False))).alias("adds"))
    )
    following = W.partitionBy("key").orderBy("valid_from")
    return daily.select("key", "valid_from", F.lead("valid_from").over(following).alias("valid_to"), "adds")


def evaluate(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched", key: str = "key", date: str = "date", adds: str = "adds") -> DataFrame:
    """captures with host, blocked, n_active (keys in force) and rule (the longest key in force)."""
    host_, date_, top_ = spare(captures.columns, "__host", "__date", "__top")
    made = captures.withColumn(host_, host_of(F.col(url))).withColumn(date_, F.col(fetched).cast("date"))
    asked = made.filter(F.col(host_).isNotNull() & F.col(date_).isNotNull()).select(F.col(host_).alias("__host"), F.col(date_).alias("__date")).distinct()
    probes = asked.select("__host", "__date", F.explode(keys_of(F.col("__host"))).alias("key"))
    spans = validity(entries, key=key, date=date, adds=adds)
    points = spans.select("key", F.col("valid_from").alias("at"), F.lit(0).alias("probe"), F.struct("valid_from", "valid_to", "adds").alias("span"))
    asks = probes.select("key", F.col("__date").alias("at"), F.lit(1).alias("probe"), F.lit(None).cast("struct<valid_from:date,valid_to:date,adds:boolean>").alias("span")).distinct()
    before = W.partitionBy("key").orderBy("at", "probe").rowsBetween(W.unboundedPreceding, 0)
    state = (
        points.unionByName(asks).withColumn("now", F.last("span", ignorenulls=True).over(before))
        .filter((F.col("probe") == 1) & F.col("now.adds")).select("key", F.col("at").alias("__date"), F.col("now.valid_from").alias("since"))
    )
    verdict = (
        probes.join(state, ["key", "__date"]).groupBy("__host", "__date")
        .agg(F.count(F.lit(1)).alias("n_active"), F.max(F.struct(F.length("key").alias("n"), "key", "since")).alias("top"))
    )
    verdict = verdict.select(F.col("__host").alias(host_), F.col("__date").alias(date_), F.col("n_active").alias("n_active"), F.col("top").alias(top_))
    kept = [c for c in captures.columns if c.lower() not in ("host", "blocked", "n_active", "rule", "rule_since")]
    return made.select(*kept, host_, date_).join(verdict, [host_, date_], "left").select(
        *kept, F.col(host_).alias("host"), F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0).cast("bigint")).alias("n_active"),
        F.col(top_)["key"].alias("rule"), F.col(top_)["since"].alias("rule_since"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    """Every page as a capture, against a dated list to which every page gives one entry: its host or, for odd
    ids, the host's last two labels, added or (one in three) removed; both dates follow from the id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    day = lambda factor: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * factor % 366).cast("int"))
    host = host_of(F.col("url"))
    domain = F.when(host.rlike(ADDRESS), F.lit("")).otherwise(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1))
    entries = pages.select(
        F.when((F.col("page_id") % 2 == 0) | (domain == ""), host).otherwise(domain).alias("key"), day(37).alias("date"), (F.col("page_id") % 3 != 0).alias("adds")
    )
    return evaluate(pages.withColumn("fetched", day(91)), entries).select("page_id", "host", "blocked", "n_active", "rule", "rule_since")


SQL = rf"""
WITH p AS (
  SELECT page_id, nullif(regexp_replace(lower(regexp_extract(url, '{HOST_PATTERN}', 1)), '\.+$', ''), '') AS host,
         DATE '2024-01-01' + CAST(page_id * 91 % 366 AS INTEGER) AS fetched, DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS listed
  FROM pages),
h AS (
  SELECT *, CASE WHEN regexp_matches(host, '{ADDRESS}') THEN '' ELSE regexp_extract(host, '([^.]+\.[^.]+)$', 1) END AS domain,
         CASE WHEN regexp_matches(host, '{ADDRESS}') THEN [host] ELSE string_split(host, '.') END AS labels FROM p),
e AS (
  SELECT key, listed AS valid_from, bool_or(adds) AS adds FROM (
    SELECT CASE WHEN page_id % 2 = 0 OR domain = '' THEN host ELSE domain END AS key, listed, page_id % 3 <> 0 AS adds FROM h)
  WHERE key IS NOT NULL GROUP BY ALL),
s AS (SELECT key, valid_from, lead(valid_from) OVER (PARTITION BY key ORDER BY valid_from) AS valid_to, adds FROM e),
k AS (
  SELECT page_id, host, fetched, array_to_string(labels[i:], '.') AS key
  FROM (SELECT *, unnest(range(1, greatest(len(labels) - 1, 1) + 1)) AS i FROM h WHERE host IS NOT NULL)),
m AS (SELECT page_id, k.key, s.valid_from FROM k JOIN s ON k.key = s.key AND fetched >= valid_from AND (valid_to IS NULL OR fetched < valid_to) WHERE adds),
v AS (SELECT page_id, count(*) AS n_active, arg_max(key, length(key)) AS rule, arg_max(valid_from, length(key)) AS rule_since FROM m GROUP BY page_id)
SELECT p.page_id, host, n_active IS NOT NULL AS blocked, coalesce(n_active, 0) AS n_active, rule, rule_since FROM p LEFT JOIN v USING (page_id)
"""
