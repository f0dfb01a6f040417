"""Expanding, purged validation folds as date predicates, and the contracts of a panel under validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.session import assert_none, assert_unique


def fold_table(panel: DataFrame, n_splits: int = 3, fold_size: int = 2, gap: int = 1, min_train: int = 6, origin: str = "origin", target_end: str | None = None) -> DataFrame:
    """(fold, train_start, train_end, test_start, test_end): the last n_splits * fold_size origins are tested in turn;
    training ends `gap` origins before.  Folds of fewer than `min_train` training origins are left out; with `target_end`,
    origins all of whose rows the purge takes don't count.  Only the distinct origins are ordered, never the rows."""
    w = W.orderBy(origin)
    ends = panel.groupBy(origin).agg(F.min(target_end or origin).alias("__ends"))
    origins = ends.select(origin, "__ends", (F.row_number().over(w) - 1).alias("i"), F.count(F.lit(1)).over(W.partitionBy()).alias("n"))
    first = F.col("n") - n_splits * fold_size + F.col("fold") * fold_size
    spread = origins.crossJoin(panel.sparkSession.range(n_splits).select(F.col("id").cast("int").alias("fold")))
    train, test = F.col("i") < first - gap, F.col("i").between(first, first + fold_size - 1)
    folds = spread.groupBy("fold").agg(
        F.min(F.when(train, F.col(origin))).alias("train_start"), F.max(F.when(train, F.col(origin))).alias("train_end"),
        F.min(F.when(test, F.col(origin))).alias("test_start"), F.max(F.when(test, F.col(origin))).alias("test_end"),
        F.count_distinct(F.when(train, F.col(origin))).alias("train_periods"), F.collect_list(F.when(train, F.col("__ends"))).alias("__ends"),
    )
    left = F.size(F.filter("__ends", lambda e: e <= F.col("test_start"))) if target_end else F.col("train_periods")
    return folds.filter((F.col("train_periods") >= min_train) & (left >= min_train)).drop("__ends")


def assign(panel: DataFrame, folds: DataFrame, origin: str = "origin", target_end: str = "target_end") -> DataFrame:
    """Rows with their fold and role; training rows whose target reaches past the first test origin are purged."""
    f = F.broadcast(folds)  # a row for each fold
    train = (F.col(origin) >= F.col("train_start")) & (F.col(origin) <= F.col("train_end")) & (F.col(target_end) <= F.col("test_start"))
    test = F.col(origin).between(F.col("test_start"), F.col("test_end"))
    return panel.join(f, train | test).select(*panel.columns, "fold", F.when(test, "test").otherwise("train").alias("role"))


def check_panel(panel: DataFrame, keys: list[str], target: str = "target", origin: str = "origin", available: str = "available_at", target_end: str = "target_end", lead: str = "lead_months") -> DataFrame:
    """Fail on duplicate keys, an unknown or infinite target, late availability or a misplaced target."""
    assert_unique(panel, keys, "panel")
    bad = (
        F.col(target).isNull() | F.isnan(target) | (F.abs(F.col(target)) == float("inf")) | (F.col(available) >= F.col(origin).cast("timestamp"))
        | (F.add_months(origin, F.col(lead)) != F.col(target_end))
    )
    return assert_none(panel, bad, "panel: a row breaks the target or availability contract")
