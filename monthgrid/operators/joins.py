"""Joins of panels with monthly tables, vintages and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.functions.calendar import shift
from monthgrid.operators.order import prefix_medians
from monthgrid.session import assert_unique


def attach(panel: DataFrame, table: DataFrame, keys: list[str], lag: int = 0, period: str = "period", check: bool = True) -> DataFrame:
    """Left many-to-one join; with a lag, the table's months move forward first, so a missing month stays missing."""
    if check:
        assert_unique(table, keys, "build side")
    moved = table.withColumn(period, shift(F.col(period), lag)) if lag else table
    return panel.join(moved, keys, "left")


def asof_strict(left: DataFrame, right: DataFrame, by: list[str], at: str, released: str, value: str) -> DataFrame:
    """The value of the latest release strictly before each row's `at`, within `by`.

    One shuffle: rows and releases are interleaved by time within a key, and the last release is carried forward;
    of equal times, rows come before releases, which makes the bound strict."""
    l_cols = left.columns
    rows = left.select("*", F.col(at).cast("timestamp").alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast(right.schema[value].dataType).alias("__v"), F.lit(None).cast("timestamp").alias("__since"))
    vintages = right.select(
        *[F.col(c) if c in by else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in l_cols],
        F.col(released).cast("timestamp").alias("__t"), F.lit(1).alias("__kind"), F.col(value).alias("__v"), F.col(released).cast("timestamp").alias("__since"),
    )
    w = W.partitionBy(*by).orderBy("__t", "__kind").rowsBetween(W.unboundedPreceding, 0)
    both = rows.unionByName(vintages).withColumns({value: F.last("__v", ignorenulls=True).over(w), f"{value}_since": F.last("__since", ignorenulls=True).over(w)})
    return both.filter("__kind = 0").select(*l_cols, value, f"{value}_since")


def last_positive_before(history: DataFrame, months: DataFrame, entity: str = "mo", period: str = "period", value: str = "y") -> DataFrame:
    """months with `filled`: the entity's last positive value strictly before the month; a newcomer gets the median
    of all positive values before it.  Values are counted by month first, and the medians of all months asked for (as many as
    a calendar has) come from one selection over these counts."""
    known = history.filter(F.col(value) > 0).select(entity, period, F.col(value).alias("__v"))
    own = asof_strict(months, known, [entity], period, period, "__v")
    dates = sorted(r[0] for r in months.filter(F.col(period).isNotNull()).select(period).distinct().collect())
    counts = known.groupBy(period, "__v").agg(F.count(F.lit(1)).alias("__n"))
    prior = prefix_medians(counts, period, "__v", "__n", dates).select(F.col(period).alias("__m"), F.col("median").alias("__median"))
    return (
        own.join(F.broadcast(prior), F.col(period) == F.col("__m"), "left")
        .select(*months.columns, F.coalesce("__v", "__median").alias("filled"), F.when(F.col("__v").isNotNull(), "history").when(F.col("__median").isNotNull(), "median").alias("fill_source"))
    )


def keep_last(df: DataFrame, keys: list[str], *ordinals: str) -> DataFrame:
    """One row for each key: the last by explicit ordinals.  An aggregate, so rows are reduced before they move."""
    last = F.max_by(F.struct(*df.columns), F.struct(*ordinals)).alias("__last")
    return df.groupBy(*keys).agg(last).select("__last.*")


def attach_region(target: DataFrame, macro: DataFrame, key: str, ordinal: str, payload: list[str], extra: list[str] = ()) -> DataFrame:
    """Left join on a canonical region key; the last duplicate wins; regional_match tells if any payload is known."""
    one = keep_last(macro, [key, *extra], ordinal).select(key, *extra, *payload)
    return target.join(one, [key, *extra], "left").withColumn("regional_match", F.coalesce(*[F.col(p).cast("string") for p in payload]).isNotNull())


def resolve(names: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """(code, name, region) to an id by the crosswalk's code, else by its (name, region), each only where unique;
    else a surrogate, with the status and confidence of each step."""
    by_code = crosswalk.filter("code is not null").groupBy("code").agg(F.count(F.lit(1)).alias("n_code"), F.min("id").alias("id_code"))
    by_name = crosswalk.groupBy("name", "region").agg(F.count(F.lit(1)).alias("n_name"), F.min("id").alias("id_name"))
    joined = names.join(by_code, "code", "left").join(by_name, ["name", "region"], "left")
    exact, cross = F.col("n_code") == 1, F.col("n_name") == 1
    unsure = (F.col("n_code") > 1) | (F.col("n_name") > 1)
    return joined.select(
        *names.columns,
        F.when(exact, F.col("id_code")).when(cross, F.col("id_name")).otherwise(F.concat_ws("::", "region", "name")).alias("id"),
        F.when(exact, "exact").when(cross, "crosswalk").when(unsure, "ambiguous").otherwise("inferred").alias("status"),
        F.when(exact, 1.0).when(cross, 0.95).when(unsure, 0.2).otherwise(0.55).alias("confidence"),
    )


def prior_news_lag(rows: DataFrame, news: DataFrame, k: int, date: str = "period") -> DataFrame:
    """The least distance in months to a news month at or before the row's, no more than k back; NULL without one."""
    back = news.select(F.col(date).alias("__n")).distinct().select("__n", F.explode(F.expr(f"sequence(0, {k})")).alias("__d"))
    reach = back.groupBy(F.add_months("__n", F.col("__d")).alias(date)).agg(F.min("__d").alias("news_lag"))
    return rows.join(reach, date, "left")
