"""What speaks for a signal or a model: ablations, comparisons, and news against alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.functions.names import first_column
from monthgrid.operators.metrics import pearson
from monthgrid.operators.order import quantiles
from monthgrid.operators.windows import by, past, quantile
from monthgrid.session import assert_none


def months_of(c: str):
    return F.year(c) * 12 + F.month(c)


def ablation(rows: DataFrame, base: str, augmented: str, *, by_: list[str] = (), target: str = "target", origin: str = "origin", available: str = "news_available_at") -> DataFrame:
    """n, the error without and with the news, its fall and the fall in percent, over rows that have all three values.
    News that weren't available before their origin are an error.  With `event_period`, `baseline_detected_at` and
    `news_detected_at` also the mean delays in days and what the news take off them.  No rows: status not_available."""
    if {origin, available} <= set(rows.columns):
        assert_none(rows, F.col(available) >= F.col(origin).cast("timestamp"), "ablation: news available only at or after the origin")
    whole = F.col(target).isNotNull() & F.col(base).isNotNull() & F.col(augmented).isNotNull()
    err = lambda c: F.avg(F.when(whole, F.abs(F.col(target) - F.col(c))))
    made = [F.sum(whole.cast("long")).alias("n"), err(base).alias("mae_without"), err(augmented).alias("mae_with")]
    delays = {"event_period", "baseline_detected_at", "news_detected_at"} <= set(rows.columns)
    if delays:
        late = lambda c: F.avg(F.datediff(c, "event_period"))
        made += [late("baseline_detected_at").alias("delay_without"), late("news_detected_at").alias("delay_with")]
    out = rows.groupBy(*by_).agg(*made)
    out = out.withColumns({
        "n": F.coalesce("n", F.lit(0).cast("long")), "mae_delta": F.col("mae_without") - F.col("mae_with"),
        "improvement_pct": F.coalesce(100 * (F.col("mae_without") - F.col("mae_with")) / F.nullif("mae_without", F.lit(0.0)), F.when(F.col("mae_without") == 0, 0.0)),
        "status": F.when(F.col("n") > 0, "measured").otherwise("not_available"),
    })
    return out.withColumn("delay_reduction", F.col("delay_without") - F.col("delay_with")) if delays else out


def benchmark_rows(scores: DataFrame, model: str, horizons: list[int], *, lead: str = "lead_months", fold: str = "fold") -> DataFrame:
    """The pooled scores of one model at each horizon asked for; `not_evaluated` where there are none."""
    asked = scores.sparkSession.createDataFrame([(h,) for h in horizons], f"{lead} int")
    own = scores.filter((F.col("model") == model) & (F.col(fold) == "pooled")).select(lead, "mae", "r2", "wape")
    status = F.when(F.col("mae").isNotNull(), "measured").otherwise("not_evaluated")
    return asked.join(own, lead, "left").select(lead, F.lit(model).alias("model"), status.alias("status"), "mae", "r2", "wape")


def verdicts(candidate: DataFrame, baseline: DataFrame, keys: list[str], tolerance: float = 0.0) -> DataFrame:
    """Per key the candidate's mae next to the baseline's, the fall in percent and the verdict: better, worse, even, or
    unknown without a baseline."""
    both = candidate.select(*keys, F.col("mae").alias("candidate_mae")).join(baseline.select(*keys, F.col("mae").alias("baseline_mae")), keys, "left")
    a, b = F.col("candidate_mae"), F.col("baseline_mae")
    verdict = F.when(a.isNull() | b.isNull(), "unknown").when(a < b - tolerance, "better").when(a > b + tolerance, "worse").otherwise("even")
    return both.withColumns({"delta_pct": 100 * (b - a) / F.nullif(b, F.lit(0.0)), "verdict": verdict})


def detected_months(rows: DataFrame, method: str, period: str = "period") -> DataFrame:
    """The distinct months of a method's shocks, in order: of its macro shocks where the frame has them."""
    column = first_column(rows, [f"{method}_macro_shock", f"{method}_shock", f"{method}s_shock"], required=False)
    if column is None:
        return rows.select(F.trunc(period, "month").alias(period)).limit(0)
    return rows.filter(F.coalesce(F.col(column).cast("boolean"), F.lit(False)) & F.col(period).isNotNull()).select(F.trunc(period, "month").alias(period)).distinct().orderBy(period)


def lead_lag(ours: DataFrame, theirs: DataFrame, period: str = "period") -> DataFrame:
    """For each distinct month of ours the months to the earliest and to the nearest of theirs (negative: before).  Only two
    calendars meet: months are few, so all of theirs go along as one sorted list."""
    other = theirs.select(months_of(period).alias("m")).distinct().agg(F.array_sort(F.collect_set("m")).alias("__all"))
    rows = ours.select(period).distinct().crossJoin(F.broadcast(other)).filter(F.size("__all") > 0)
    gaps = F.transform("__all", lambda m: m - months_of(period))
    return rows.select(period, F.array_min(gaps).alias("to_earliest"), F.array_min(F.transform(gaps, F.abs)).alias("to_nearest"))


def territorial_fallback(panel: DataFrame, *, window: int = 24, history: int = 4, q: float = 0.9, value: str = "y") -> DataFrame:
    """Residual evidence without a model: the step from the row before against the q-quantile of its own past steps."""
    rows = panel.withColumn("residual", F.abs(F.col(value) - F.lag(value, 1).over(by())))
    bar = quantile("residual", q, past(by(), window), history)
    rows = rows.withColumn("__bar", bar)
    return rows.withColumns({
        "residual_eligible": F.col("__bar").isNotNull(), "residual_shock": F.coalesce(F.col("residual") >= F.col("__bar"), F.lit(False)),
        "residual_score": F.when(F.col("__bar").isNotNull(), F.col("residual") / F.greatest("__bar", F.lit(1e-8))), "detected_at": F.add_months("period", 1),
    }).drop("__bar")


def news_validation(rows: DataFrame, shocks: list[str], *, threshold: float = 0.085, news: str = "news_shock_score", residual: str = "residual", entity: str = "mo", period: str = "period") -> DataFrame:
    """One row: the size of the news of a month against the alerts and residuals of the next, over months that have all.
    A month alerts where the largest share among the methods reaches the threshold; the news peak at or over their upper
    quartile.  Months without a row before don't count.  The window runs over months only."""
    from pyspark.sql import Window as W

    share = F.greatest(*[F.avg(F.coalesce(F.col(s).cast("int"), F.lit(0))) for s in shocks]) if len(shocks) > 1 else F.avg(F.coalesce(F.col(shocks[0]).cast("int"), F.lit(0)))
    local = rows.filter(F.col(entity) != "__national__")
    monthly = local.groupBy(F.trunc(period, "month").alias(period)).agg(
        share.alias("share"), F.avg(F.abs(F.col(residual))).alias("size"), F.percentile(news, F.lit(0.5)).alias("__news")
    )
    before = F.lag(F.abs("__news"), 1).over(W.orderBy(period))
    months = monthly.withColumn("news", before).filter("news is not null and size is not null and share is not null")
    bar = quantiles(months, "news", [0.75]).select(F.col("q")[0].alias("__bar"))
    months = months.crossJoin(F.broadcast(bar))
    peak, alert = F.col("news") >= F.col("__bar"), F.col("share") >= threshold
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0).cast("long"))
    both, any_ = n(peak & alert), n(peak | alert)
    return months.agg(
        F.count(F.lit(1)).alias("months"), n(peak).alias("peaks"), n(alert).alias("alerts"), both.alias("validated"),
        F.when(any_ > 0, both / any_).otherwise(0.0).alias("jaccard"), F.coalesce(pearson("news", "share"), F.lit(0.0)).alias("correlation_share"),
        F.coalesce(pearson("news", "size"), F.lit(0.0)).alias("correlation_size"), F.when(both > 0, 1.0).otherwise(0.0).alias("lead_months"),
    )


def local_shock(rows: DataFrame, shock: str = "news_shock_score", volatility: str = "spending_volatility") -> DataFrame:
    """rows with the news shock weighted by the entity's own volatility."""
    return rows.withColumn("local_news_shock", F.col(shock) * F.col(volatility))
