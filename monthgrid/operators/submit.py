"""The forecast grid: complete, unique, finite and in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.operators import order
from monthgrid.operators.impute import fill_predictions
from monthgrid.session import assert_none, assert_unique, materialized


def grid(roster: DataFrame, months: DataFrame, entity: str = "mo", period: str = "period") -> DataFrame:
    """Every entity with every month (a few months: the smaller side is broadcast)."""
    return roster.select(entity).distinct().crossJoin(F.broadcast(months.select(period).distinct()))


def assemble(roster: DataFrame, months: DataFrame, predictions: DataFrame, *, pred: str = "pred", fill: bool = False, entity: str = "mo", period: str = "period") -> DataFrame:
    """The grid with its predictions.  Without `fill` a missing one is an error; negative or infinite ones always are."""
    assert_unique(predictions, [entity, period], "predictions")
    strangers = predictions.join(roster, entity, "left_anti").limit(1).count()
    if strangers:
        raise ValueError("predictions: an entity is not in the roster")
    rows = grid(roster, months, entity, period).join(predictions.select(entity, period, pred), [entity, period], "left")
    rows = materialized(fill_predictions(rows, pred, entity, period) if fill else rows, "grid")  # checked, then returned
    assert_none(rows, F.col(pred).isNull() | F.isnan(pred) | (F.abs(F.col(pred)) == float("inf")) | (F.col(pred) < 0), "predictions: missing, negative or infinite")
    return rows.select(entity, period, pred).orderBy(entity, period)


def select_arm(predictions: DataFrame, arm: str, entities: int, entity: str = "mo") -> DataFrame:
    """The chosen arm as pred.  The column must exist (no other is taken for it), over exactly that many entities."""
    if arm not in predictions.columns:
        raise ValueError(f"no forecast column {arm}; there are {[c for c in predictions.columns if c.startswith('pred')]}")
    n = predictions.select(entity).distinct().count()
    if n != entities:
        raise ValueError(f"{n} entities, not {entities}")
    return predictions.withColumn("pred", F.col(arm))


def quantiles(rows: DataFrame, c: str = "pred") -> DataFrame:
    """The least, the quartiles and the greatest value, exactly."""
    return order.quantiles(rows, c, [0.0, 0.25, 0.5, 0.75, 1.0]).select(*[F.col("q")[i].alias(f"q{n}") for i, n in enumerate((0, 25, 50, 75, 100))])


def cold_start(history: DataFrame, entities: DataFrame, entity: str = "mo", period: str = "period", value: str = "y") -> DataFrame:
    """(entity, forecast): last value times 1 + the median growth of all training rows, at least 0; without history the
    training median."""
    from pyspark.sql import Window as W

    known = history.filter(F.col(value).isNotNull())
    before = F.lag(value).over(W.partitionBy(entity).orderBy(period))
    growth = known.select((F.col(value) / F.nullif(before, F.lit(0.0)) - 1).alias("g"))
    growth, median = order.median(growth, "g", "__g"), order.median(known, value, "__m")
    last = known.groupBy(entity).agg(F.max_by(value, period).alias("__last"))
    rows = entities.join(last, entity, "left").join(F.broadcast(growth), F.lit(True), "left").join(F.broadcast(median), F.lit(True), "left")
    return rows.select(entity, F.coalesce(F.greatest(F.col("__last") * (1 + F.coalesce("__g", F.lit(0.0))), F.lit(0.0)), "__m").alias("forecast"))


def last_value_arm(history: DataFrame, rows: DataFrame, entity: str = "mo", period: str = "period", value: str = "y") -> DataFrame:
    """rows with the last finite value of their entity (0 without one): the fallback of every arm, named so in `mode`."""
    ok = F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))
    last = history.filter(ok).groupBy(entity).agg(F.max_by(value, period).alias("__last"))
    return rows.join(last, entity, "left").withColumns({"pred": F.coalesce("__last", F.lit(0.0)), "mode": F.lit("fallback_last_value")}).drop("__last")
