"""Line dedup by site-relative frequency, in DataFrame functions only.

A line (without the white space at its ends: blank, \\t, \\v, \\f, \\r; lines of nothing else never count) is boilerplate on its host when the share of the host's pages that
contain it exceeds `ratio` and at least `min_pages` pages contain it.  Pages are counted once for a line,
however often they repeat it.  Counting runs over line hashes with partial sums, so a host that holds a third
of all pages is combined before the shuffle; the few candidates are then counted again by their exact text.
For each host there are at most (lines a page / ratio) such lines, whatever its number of pages.

Defined results: null text stays null and counts as a page without lines; pages without a host keep every
line; very long texts are split whole, and a line of any length is one line; a share at the ratio is no boilerplate; repeated rows are pages of their own; an empty table gives an empty table; all other columns pass
through untouched, whatever their names (but for __n_lines and __n_dropped, which are replaced).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtools import small_side, spare, written

RATIO, MIN_PAGES = 0.05, 5
HOST, LINE, BOILER = "__host", "__line", "__boiler"
#: White space at the ends of a line.
SPACE = " \t\v\f\r"


def page_lines(pages: DataFrame, host: str, text: str) -> DataFrame:
    """One row for each distinct non-blank line of a page that has a host."""
    lines = F.array_distinct(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x, F.lit(SPACE))))
    return (
        pages.filter(F.col(host).isNotNull())
        .select(F.col(host).alias(HOST), F.explode(lines).alias(LINE))
        .filter(F.col(LINE) != "")
    )


def boilerplate(pages: DataFrame, *, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line, pages, share) of every boilerplate line."""
    totals = pages.filter(F.col(host).isNotNull()).groupBy(F.col(host).alias(HOST)).agg(F.count(F.lit(1)).alias("__pages"))
    often = lambda counts: counts.filter(F.col("__n") >= min_pages).join(totals, HOST).filter(F.col("__n") > ratio * F.col("__pages"))
    lines = page_lines(pages, host, text)
    hashed = lines.select(HOST, F.xxhash64(LINE).alias("__h")).groupBy(HOST, "__h").agg(F.count(F.lit(1)).alias("__n"))
    likely = written(often(hashed).select(HOST, "__h"), "line-candidates")
    exact = (
        lines.withColumn("__h", F.xxhash64(LINE)).join(small_side(likely), [HOST, "__h"], "left_semi")
        .groupBy(HOST, LINE).agg(F.count(F.lit(1)).alias("__n"))
    )
    return often(exact).select(
        F.col(HOST).alias("host"), F.col(LINE).alias("line"), F.col("__n").alias("pages"), (F.col("__n") / F.col("__pages")).alias("share")
    )


def drop_boilerplate(pages: DataFrame, *, host: str, text: str, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """pages with `text` rewritten, and __n_lines and __n_dropped added (both 0 for null text)."""
    found = boilerplate(pages, host=host, text=text, ratio=ratio, min_pages=min_pages)
    by_host = written(found.groupBy(F.col("host").alias(HOST)).agg(F.collect_set("line").alias(BOILER)), "line-boilerplate")
    host_, boiler_, kept_ = spare(pages.columns, HOST, BOILER, "__kept")
    lines = F.split(pages[text], "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains(F.col(boiler_), F.trim(x, F.lit(SPACE))))
    count = lambda n: F.when(pages[text].isNull(), 0).otherwise(n).cast("bigint")
    by_host = small_side(by_host).select(F.col(HOST).alias(host_), F.col(BOILER).alias(boiler_))
    return (
        pages.join(by_host, pages[host] == F.col(host_), "left")
        .withColumn(kept_, F.when(F.col(boiler_).isNull(), lines).otherwise(kept))
        .select(
            *(F.array_join(kept_, "\n").alias(c) if c == text else pages[c] for c in pages.columns if c not in ("__n_lines", "__n_dropped")),
            count(F.size(lines)).alias("__n_lines"), count(F.size(lines) - F.size(kept_)).alias("__n_dropped"),
        )
    )


def op3(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    done = drop_boilerplate(docs, host="source", text="text")
    return done.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("kept_bytes"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


SQL = rf"""
WITH l AS (SELECT DISTINCT doc_id, source, trim(x, e' \t\x0B\f\r') AS line FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS x FROM documents) WHERE trim(x, e' \t\x0B\f\r') <> ''),
t AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
b AS (SELECT source, line FROM (SELECT source, line, count(*) AS n FROM l GROUP BY source, line) JOIN t USING (source) WHERE n >= {MIN_PAGES} AND n > {RATIO} * total),
d AS (SELECT doc_id, source, string_split(text, chr(10)) AS ls FROM documents),
p AS (SELECT doc_id, source, k, ls[k] AS x FROM (SELECT doc_id, source, ls, unnest(range(1, len(ls) + 1)) AS k FROM d)),
q AS (SELECT p.doc_id, p.k, p.x, b.line IS NOT NULL AS gone FROM p LEFT JOIN b ON p.source = b.source AND trim(p.x, e' \t\x0B\f\r') = b.line),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, coalesce(string_agg(x, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM q GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, CAST(coalesce(strlen(kept), 0) AS BIGINT) AS kept_bytes, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN r USING (doc_id)
"""
