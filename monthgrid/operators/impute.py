"""Imputation fitted on training rows only, with the source of every value."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.operators import order
from monthgrid.operators.order import median


def one_row(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows with the columns of a table of at most one row; NULLs without it."""
    return rows.join(F.broadcast(one), F.lit(True), "left")


def fold_median(rows: DataFrame, columns: list[str], train) -> DataFrame:
    """NULLs filled by the exact median of the training rows; a column without any is filled with 0.  The medians of all
    columns come from one selection."""
    seen = rows if train is None else rows.filter(train)
    medians = order.wide(order.quantiles_of(seen, columns, [0.5]), columns, lambda c: [f"__{c}"])
    out = one_row(rows, medians)
    return out.withColumns({c: F.coalesce(c, f"__{c}", F.lit(0.0)) for c in columns}).select(rows.columns)


def district_median(rows: DataFrame, train: DataFrame, column: str, district: str, entity: str = "mo", period: str = "period", limit: int = 2) -> DataFrame:
    """The value, else the district's training median, else the value carried over at most `limit` rows, else the
    global training median; `<column>_source` says which."""
    by_district = median(train, column, "__d", [district])
    overall = median(train, column, "__g")
    w = W.partitionBy(entity).orderBy(period).rowsBetween(-limit, 0)
    joined = rows.withColumn("__f", F.last(column, ignorenulls=True).over(w)).join(by_district, district, "left")
    joined = one_row(joined, overall)
    source = F.when(F.col(column).isNotNull(), "region").when(F.col("__d").isNotNull(), "federal_district").when(F.col("__f").isNotNull(), "forward_fill").when(F.col("__g").isNotNull(), "global")
    return joined.withColumns({column: F.coalesce(column, "__d", "__f", "__g"), f"{column}_source": source}).drop("__d", "__f", "__g")


def scaled(rows: DataFrame, columns: list[str], train, robust: bool = False) -> DataFrame:
    """Standard (mean, population deviation) or robust (median, quartile range) scaling by the training rows."""
    out = rows
    if robust:
        found = order.wide(order.quantiles_of(rows.filter(train), columns, [0.25, 0.5, 0.75]), columns, lambda c: [f"__l_{c}", f"__m_{c}", f"__h_{c}"])
        out = one_row(out, found.withColumns({f"__s_{c}": F.col(f"__h_{c}") - F.col(f"__l_{c}") for c in columns}))
    else:
        v = {c: F.when(train, F.col(c)) for c in columns}
        out = out.crossJoin(F.broadcast(rows.agg(*[F.avg(v[c]).alias(f"__m_{c}") for c in columns], *[F.stddev_pop(v[c]).alias(f"__s_{c}") for c in columns])))
    made = {c: (F.col(c) - F.col(f"__m_{c}")) / F.when(F.col(f"__s_{c}") > 0, F.col(f"__s_{c}")).otherwise(1.0) for c in columns}
    return out.withColumns(made).select(rows.columns)


def fill_predictions(grid: DataFrame, c: str = "pred", entity: str = "mo", period: str = "period") -> DataFrame:
    """Forward, then backward within an entity, then the month's median, then the median of all: over predictions only."""
    w = W.partitionBy(entity).orderBy(period)
    near = F.coalesce(F.last(c, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first(c, ignorenulls=True).over(w.rowsBetween(0, W.unboundedFollowing)))
    rows = grid.withColumn("__near", near)
    joined = one_row(rows.join(median(rows, "__near", "__month", [period]), period, "left"), median(rows, "__near", "__all"))
    return joined.withColumn(c, F.coalesce("__near", "__month", "__all")).select(grid.columns)


def normalised_ratios(panel: DataFrame, value: str = "y", wage: str = "wage", employment: str = "employment") -> DataFrame:
    """y per wage and per employed (NULL where they aren't positive) and the wage's growth over twelve rows."""
    per = lambda d: F.when(F.col(d) > 0, F.col(value) / F.col(d))
    before = F.lag(wage, 12).over(W.partitionBy("mo").orderBy("period"))
    return panel.withColumns({"y_per_wage": per(wage), "y_per_employed": per(employment), "wage_growth_yoy": F.col(wage) / F.nullif(before, F.lit(0.0)) - 1})
