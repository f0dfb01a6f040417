"""News records to monthly signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_filled(*names: str):
    """The first of the columns that isn't blank."""
    return F.coalesce(*[F.nullif(F.trim(F.col(n)), F.lit("")) for n in names])


def verdicts(records: DataFrame, *, body: str = "text", date: str = "date", least: int = 40, keywords: list[str] = ()) -> DataFrame:
    """records with `reason`: why a record is rejected, NULL for the others."""
    words = F.lit(True)
    if keywords:
        words = F.lit(False)
        for k in keywords:
            words = words | F.lower(body).contains(k.lower())
    reason = (
        F.when(F.col(date).isNull(), "no_date").when(F.col(body).isNull() | (F.col(body) == ""), "no_text")
        .when(F.length(body) < least, "short").when(~words, "no_keyword")
    )
    return records.withColumn("reason", reason)


def dedup(records: DataFrame, *, source: str = "source", article: str = "article_id", url: str = "url", body: str = "text", order: list[str] = ("date", "seq")) -> DataFrame:
    """Drop a record when an earlier one has its (source, id), its url or its text; every key is judged on all records.

    Keys are kept as their first record by partial aggregation, so a text that most records share is no hot window."""
    first = F.min(F.struct(*order))
    text_key = F.sha2(F.lower(F.trim(F.regexp_replace(body, r"\s+", " "))), 256)
    rows = records.withColumns({
        "__id": F.when(F.col(article).isNotNull() & (F.col(article) != ""), F.concat_ws("\u0001", source, article)),
        "__url": F.nullif(F.col(url), F.lit("")), "__text": text_key, "__me": F.struct(*order),
    })
    for k in ("__id", "__url", "__text"):
        firsts = rows.filter(F.col(k).isNotNull()).groupBy(k).agg(first.alias("__f"), F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(k, F.col("__f").alias(f"{k}_first"))
        rows = rows.join(firsts, k, "left")
    keep = [F.col(f"{k}_first").isNull() | (F.col("__me") == F.col(f"{k}_first")) for k in ("__id", "__url", "__text")]
    return rows.filter(keep[0] & keep[1] & keep[2]).select(records.columns)


def monthly(scored: DataFrame, *, period: str = "period", score: str = "score") -> DataFrame:
    """A row for each month between the first and last: mean score (NULL without news), volume (0) and log volume."""
    counts = scored.groupBy(period).agg(F.avg(score).alias("sentiment_index"), F.count(F.lit(1)).alias("news_volume"))
    ends = counts.agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    months = ends.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias(period))
    volume = F.coalesce("news_volume", F.lit(0)).cast("bigint")
    return months.join(counts, period, "left").select(period, "sentiment_index", volume.alias("news_volume"), F.log1p(volume).alias("news_log_volume"))


def shock(months: DataFrame, period: str = "period", n: int = 3) -> DataFrame:
    """Both forms of a news shock: the volume over its mean of n months before (all needed), and the z-score of the log
    volume (0 where it can't be told).  The window runs over months only."""
    w = W.orderBy(period).rowsBetween(-n, -1)
    whole = F.count("news_volume").over(w) == n
    sd = F.stddev_samp("news_log_volume").over(w)
    return months.withColumns({
        "news_shock_score": F.when(whole, F.col("news_volume") - F.avg("news_volume").over(w)),
        "news_shock_index": F.when(whole & (sd > 1e-10), (F.col("news_log_volume") - F.avg("news_log_volume").over(w)) / sd).otherwise(0.0),
    })


#: A text's terms: runs of letters and digits, and runs of other characters that aren't blanks.
TERMS = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]+"


def fit_scorer(texts: DataFrame, body: str, label: str, *, bits: int = 14, rate: float = 0.01, rounds: int = 25):
    """A fitted pipeline that gives texts the probability of label 1 (`scored` reads it): logistic regression on the hashed terms
    and pairs of neighbouring terms of a text, each text scaled to length one.  All of it is Spark ML in the JVM, so it learns from
    any number of rows, and `save` keeps it."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, NGram, Normalizer, RegexTokenizer, VectorAssembler

    stages = [
        RegexTokenizer(inputCol=body, outputCol="__terms", pattern=TERMS, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="__terms", outputCol="__pairs"),
        HashingTF(inputCol="__terms", outputCol="__one", numFeatures=1 << bits), HashingTF(inputCol="__pairs", outputCol="__two", numFeatures=1 << bits),
        Normalizer(inputCol="__one", outputCol="__n1"), Normalizer(inputCol="__two", outputCol="__n2"), VectorAssembler(inputCols=["__n1", "__n2"], outputCol="__x"),
        LogisticRegression(featuresCol="__x", labelCol="__label", regParam=rate, maxIter=rounds, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y"),
    ]
    known = texts.filter(F.col(body).isNotNull() & F.col(label).isNotNull()).select(body, F.col(label).cast("double").alias("__label"))
    return Pipeline(stages=stages).fit(known)


def scored(records: DataFrame, scorer, body: str = "text") -> DataFrame:
    """records with `score`; every distinct text is scored once, and null texts have none.  Texts meet by their digests, so
    that only one copy of each goes to the scorer.  scorer: fit_scorer's, or a function that gives rows with `body` their `score`."""
    from pyspark.ml.functions import vector_to_array

    digest = F.sha2(body, 256)
    unique = records.filter(F.col(body).isNotNull()).groupBy(digest.alias("__k")).agg(F.first(body).alias(body))
    fitted = getattr(scorer, "transform", None)
    scores = fitted(unique).select("__k", vector_to_array("__p")[1].alias("score")) if fitted else scorer(unique).select("__k", "score")
    return records.withColumn("__k", digest).join(scores, "__k", "left").drop("__k")
