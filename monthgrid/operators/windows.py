"""Causal windows of a panel.  Every frame ends before the row, and all share one partitioning and order, so one
shuffle and one sort serve all of them.  A frame with a missing value, or too few rows, gives NULL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.functions.numbers import growth, ratio


def by(entity: str = "mo", period: str = "period"):
    return W.partitionBy(entity).orderBy(period)


def past(w, n: int):
    return w.rowsBetween(-n, -1)


def all_past(w):
    return w.rowsBetween(W.unboundedPreceding, -1)


def full(c: str, w, n: int, value: Column, least: int | None = None) -> Column:
    """value where the frame over w has `least` (or n) known values."""
    return F.when(F.count(c).over(w) >= (least or n), value)


def lags(c: str, ks, w) -> dict[str, Column]:
    return {f"{c}_lag_{k}": F.lag(c, k).over(w) for k in ks}


def rolling(c: str, windows, w) -> dict[str, Column]:
    made = {}
    for n in windows:
        f = past(w, n)
        for name, g in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)):
            made[f"{c}_{name}_{n}"] = full(c, f, n, g(c).over(f))
    return made


def growths(c: str, w) -> dict[str, Column]:
    one = F.lag(c, 1).over(w)
    return {f"{c}_growth_mom": growth(one, F.lag(c, 2).over(w)), f"{c}_growth_yoy": growth(one, F.lag(c, 13).over(w))}


def volatility(c: str, w) -> Column:
    """The spread of all past values relative to their mean."""
    f = all_past(w)
    return F.when(F.count(c).over(f) >= 2, ratio(F.stddev_samp(c).over(f), F.abs(F.avg(c).over(f))))


def age(w) -> Column:
    return F.row_number().over(w) - 1


def causal(panel: DataFrame, *, lag_months=(1, 2, 3, 12), windows=(3, 12), value: str = "y") -> DataFrame:
    """Every row of a regular panel with its causal features."""
    w = by()
    made = lags(value, lag_months, w) | growths(value, w) | rolling(value, windows, w) | {"spending_volatility": volatility(value, w)}
    return panel.select("*", *(c.alias(n) for n, c in made.items()))


def features(panel: DataFrame, *, lag_months=(1, 2, 3, 12), windows=(3, 12), warmup: int = 12, value: str = "y") -> DataFrame:
    """A regular panel with its causal features, without the warm-up months and the rows of unknown value."""
    rows = causal(panel.withColumn("__age", age(by())), lag_months=lag_months, windows=windows, value=value)
    return rows.filter((F.col("__age") >= warmup) & F.col(value).isNotNull()).drop("__age")


def quantile(c: str, q: float, w, least: int = 1) -> Column:
    """The linearly interpolated quantile of a frame's known values."""
    return F.when(F.count(c).over(w) >= least, F.expr(f"percentile({c}, {q})").over(w))


def zscore(c: str, n: int, w, least: int) -> Column:
    f = past(w, n)
    return F.when(F.count(c).over(f) >= least, (F.col(c) - F.avg(c).over(f)) / F.greatest(F.stddev_samp(c).over(f), F.lit(1e-8)))


def filled(c: str, w, limit: int) -> Column:
    """The value carried forward over at most `limit` rows."""
    return F.last(c, ignorenulls=True).over(w.rowsBetween(-limit, 0))


def run_of(period: str, w) -> Column:
    """A number that stays the same within a run of consecutive months."""
    return (F.year(period) * 12 + F.month(period)) - F.row_number().over(w)


def last_rows(df: DataFrame, n: int, entity: str = "mo", period: str = "period") -> DataFrame:
    w = W.partitionBy(entity).orderBy(F.col(period).desc())
    return df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")
