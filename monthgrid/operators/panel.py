"""The monthly panel: one row for each entity and month, gap-free within an entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.functions.calendar import month_start, shift


def calendar(panel: DataFrame, entity: str = "mo", period: str = "period") -> DataFrame:
    """Every month between an entity's first and last."""
    ends = panel.groupBy(entity).agg(F.min(period).alias("lo"), F.max(period).alias("hi"))
    return ends.select(entity, F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias(period))


def regularize(panel: DataFrame, entity: str = "mo", period: str = "period") -> DataFrame:
    """The panel on its full calendar; months without a row have NULLs.

    One scan and one shuffle: an entity's months are bounded, so the missing ones are found by a window over its own
    rows (each row brings the months up to the next one) instead of a second aggregate of the same table."""
    from pyspark.sql import Window as W

    following = F.lead(period).over(W.partitionBy(entity).orderBy(period))
    gap = F.expr(f"sequence({period}, coalesce(add_months(__next, -1), {period}), interval 1 month)")
    rows = panel.withColumn("__next", following).select("*", F.posexplode(gap).alias("__k", "__month"))
    values = [F.when(F.col("__k") == 0, F.col(c)).alias(c) for c in panel.columns if c not in (entity, period)]
    return rows.select(entity, F.col("__month").cast("date").alias(period), *values)


def direct(panel: DataFrame, h: int, entity: str = "mo", period: str = "period", value: str = "y") -> DataFrame:
    """Supervised rows at horizon h: the features of the origin month with the value h months later as target."""
    target = panel.select(entity, shift(F.col(period), -h).alias(period), F.col(value).alias("target"))
    rows = panel.join(target.filter("target is not null"), [entity, period])
    return rows.withColumnsRenamed({period: "origin"}).withColumns({
        "target_end": shift(F.col("origin"), h), "lead_months": F.lit(h),
        "available_at": F.col("origin").cast("timestamp") - F.expr("interval 1 microsecond"),
    })


def nation_panel(spark, sf_dir: str, finer: bool = False) -> DataFrame:
    """The test tables' panel: monthly order value (y, two decimals) of each nation, or nation and segment."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    orders = read("orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = read("nation").select("n_nationkey", "n_name")
    entity = F.concat_ws("/", "n_name", "c_mktsegment") if finer else F.col("n_name")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.groupBy(entity.alias("mo"), month_start(F.col("o_orderdate")).alias("period")).agg(F.round(F.sum("o_totalprice"), 2).alias("y"))
