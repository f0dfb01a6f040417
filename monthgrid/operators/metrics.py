"""Forecast, agreement and detector metrics as single aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.operators.order import ranked


def long_form(oof: DataFrame, arms: list[str], keys: list[str]) -> DataFrame:
    """One row for each key and arm: model, pred, target."""
    return oof.unpivot([*keys, "target"], arms, "model", "pred").filter("target is not null and pred is not null")


def accuracy(rows: DataFrame, by: list[str]) -> DataFrame:
    """n, MAE, RMSE, WAPE and R2; R2 is NULL under two rows or for a constant target."""
    e = F.col("target") - F.col("pred")
    sst = F.var_pop("target") * F.count(F.lit(1))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.sum(F.abs(e)) / F.nullif(F.sum(F.abs("target")), F.lit(0.0))).alias("wape"),
        F.when((F.count(F.lit(1)) >= 2) & (F.max("target") > F.min("target")), 1 - F.sum(e * e) / sst).alias("r2"),
    )


def pooled(rows: DataFrame, by: list[str], fold: str = "fold") -> DataFrame:
    """accuracy by fold, and over all folds together (fold 'pooled'), in one expansion of the rows."""
    both = rows.withColumn(fold, F.explode(F.array(F.col(fold).cast("string"), F.lit("pooled"))))
    return accuracy(both, [fold, *by])


def complete_leads(oof: DataFrame, h: int, keys: list[str], lead: str = "lead_months") -> DataFrame:
    """The rows of leads 1..h of those keys that have them all."""
    within = oof.filter(F.col(lead).between(1, h))
    whole = within.groupBy(*keys).agg(F.count_distinct(lead).alias("__n")).filter(F.col("__n") == h).drop("__n")
    return within.join(whole, keys, "left_semi")


def improvement(metrics: DataFrame, by: list[str], baseline: str, metric: str = "mae") -> DataFrame:
    """The relative gain over the baseline model within each group."""
    w = W.partitionBy(*by)
    base = F.max(F.when(F.col("model") == baseline, F.col(metric))).over(w)
    return metrics.withColumn("improvement", (base - F.col(metric)) / F.nullif(base, F.lit(0.0)))


def pearson(x: str, y: str) -> Column:
    """The correlation; NULL where a side is constant (corr itself is an error there under ANSI)."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def correlations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson and Spearman over rows with both values; 0 where either side is constant."""
    known = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    on = lambda c: ranked(known, c).select(F.col("value").alias(f"__v_{c}"), F.col("rank").alias(f"__rank_{c}"))
    rows = known.join(on(x), F.col(x) == F.col(f"__v_{x}")).join(on(y), F.col(y) == F.col(f"__v_{y}"))
    varied = (F.max(x) > F.min(x)) & (F.max(y) > F.min(y))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), F.when(varied, pearson(x, y)).otherwise(0.0).alias("pearson"),
        F.when(varied, pearson(f"__rank_{x}", f"__rank_{y}")).otherwise(0.0).alias("spearman"),
    )


def jaccard_rows(a: Column, b: Column, empty: float = 1.0) -> Column:
    """Row-wise agreement of two flags; `empty` where neither is ever set."""
    union = F.sum((a | b).cast("int"))
    return F.when(union > 0, F.sum((a & b).cast("int")) / union).otherwise(empty)


def jaccard_sets(flags: DataFrame, key: str, item: str, empty: float = 0.0) -> DataFrame:
    """Pairwise agreement of the item sets of keys (a few methods): (key_a, key_b, jaccard)."""
    sets = flags.groupBy(key).agg(F.collect_set(item).alias("s"))
    a, b = sets.select(F.col(key).alias(f"{key}_a"), F.col("s").alias("a")), sets.select(F.col(key).alias(f"{key}_b"), F.col("s").alias("b"))
    union = F.size(F.array_union("a", "b"))
    pairs = a.join(b, F.col(f"{key}_a") < F.col(f"{key}_b"))
    return pairs.select(f"{key}_a", f"{key}_b", F.when(union > 0, F.size(F.array_intersect("a", "b")) / union).otherwise(empty).alias("jaccard"))


def detector_summary(rows: DataFrame, shock: str, eligible: str, entity: str = "mo", period: str = "period") -> DataFrame:
    """Shocks, their rate, eligible rows, distinct entities, and the mean months between shocks of one entity."""
    hit = F.col(shock) & F.col(eligible)
    before = F.lag(period).over(W.partitionBy(entity).orderBy(period))
    gaps = rows.filter(hit).withColumn("__gap", (F.year(period) * 12 + F.month(period)) - (F.year(before) * 12 + F.month(before)))
    base = rows.agg(
        F.sum(hit.cast("long")).alias("shocks"), F.sum(F.col(eligible).cast("long")).alias("eligible"),
        F.count_distinct(F.when(hit, F.col(entity))).alias("entities"),
    )
    return base.crossJoin(gaps.agg(F.avg("__gap").alias("mean_gap"))).withColumn("rate", F.col("shocks") / F.nullif(F.col("eligible"), F.lit(0)))
