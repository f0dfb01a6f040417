"""A stratified subset of entities: levels, quartile strata, anchors, and a seeded draw of even sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.functions.names import first_column
from monthgrid.operators import order


def levels(panel: DataFrame, value: str | None = None, entity: str = "mo", among: DataFrame | None = None) -> DataFrame:
    """(entity, level): the mean of each entity where it is positive.  Without `value` the column is `target`, else `y`;
    with `among`, only entities of that table count."""
    column = value or first_column(panel, ["target", "y"])
    rows = panel if among is None else panel.join(among.select(entity).distinct(), entity, "left_semi")
    return rows.groupBy(entity).agg(F.avg(column).alias("level")).filter("level > 0")


def strata(rows: DataFrame, level: str = "level", parts: int = 4, entity: str = "mo") -> DataFrame:
    """rows with `stratum` 0 to parts - 1 by the exact quantiles of the level, the upper bound included.  Where ties leave a
    stratum empty, strata are of equal rank instead (ties in the order of the entity)."""
    cuts = order.quantiles(rows, level, [k / parts for k in range(1, parts)])
    found = cuts.first()
    bounds = list(found["q"]) if found and found["q"] is not None else []
    if not bounds:
        return rows.withColumn("stratum", F.lit(None).cast("int"))
    place = F.lit(0)
    for b in bounds:
        place = place + (F.col(level) > F.lit(float(b))).cast("int")
    made = rows.withColumn("stratum", place)
    if made.filter(F.col(level).isNotNull()).select("stratum").distinct().count() == parts:
        return made
    # Ranks over all rows without one task for them: the rank of the value, then the place among its equals.
    first = order.ranked(rows, level).select(F.col("value").alias("__v"), F.col("rank").alias("__rank"))
    tied = W.partitionBy("__v").orderBy(entity)
    ranked = rows.join(first, F.col(level) == F.col("__v"), "left")
    ranked = ranked.withColumns({"__n": F.count(F.lit(1)).over(W.partitionBy("__v")), "__k": F.row_number().over(tied)})
    at = F.col("__rank") - (F.col("__n") + 1) / 2.0 + F.col("__k")  # 1 to n, each once
    n = rows.filter(F.col(level).isNotNull()).count()
    cut = F.lit(0)
    for k in range(1, parts):
        cut = cut + (at > F.lit(1 + (n - 1) * k / parts)).cast("int")
    return ranked.withColumn("stratum", F.when(F.col("__v").isNotNull(), cut)).select(*rows.columns, "stratum")


def even_sizes(total: int, parts: int) -> list[int]:
    """total in parts that differ by one at most, larger ones first."""
    return [total // parts + (k < total % parts) for k in range(parts)]


def anchors(entities: DataFrame, wanted: dict[str, str], entity: str = "mo") -> DataFrame:
    """(anchor, entity): for each name its one entity that contains the text, in any case; none or several are an error."""
    names = entities.sparkSession.createDataFrame(list(wanted.items()), "anchor string, __text string")
    hit = F.lower(F.col(entity)).contains(F.lower("__text"))
    found = entities.select(entity).distinct().join(F.broadcast(names), hit)
    bad = names.join(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")), "anchor", "left").filter("n is null or n <> 1").select("anchor", F.coalesce("n", F.lit(0)).alias("n")).collect()
    if bad:
        raise ValueError(f"anchors must match one entity each: {({r.anchor: r.n for r in bad})}")
    return found.select("anchor", entity)


def draw(rows: DataFrame, sizes: list[int], seed: int = 42, stratum: str = "stratum", entity: str = "mo") -> DataFrame:
    """sizes[k] entities of stratum k, first in the order of a seeded hash; a stratum that has fewer is an error."""
    want = rows.sparkSession.createDataFrame(list(enumerate(sizes)), f"{stratum} int, __want int")
    have = want.join(rows.groupBy(stratum).agg(F.count(F.lit(1)).alias("n")), stratum, "left").filter("coalesce(n, 0) < __want").collect()
    if have:
        raise ValueError(f"too few entities in {({r[stratum]: r.n for r in have})}")
    w = W.partitionBy(stratum).orderBy(F.xxhash64(entity, F.lit(seed)), entity)
    placed = rows.withColumn("place", F.row_number().over(w)).join(F.broadcast(want), stratum)
    return placed.filter("place <= __want").drop("__want")


def benchmark_subset(panel: DataFrame, size: int, wanted: dict[str, str], seed: int = 42, value: str | None = None, among: DataFrame | None = None, entity: str = "mo") -> DataFrame:
    """(entity, level, stratum) of `size` entities: the anchors (stratum NULL) and an even draw from the quartiles of the rest."""
    known = levels(panel, value, entity, among)
    fixed = anchors(known, wanted, entity)
    rest = strata(known.join(fixed, entity, "left_anti"), entity=entity)
    chosen = draw(rest, even_sizes(size - len(wanted), 4), seed, entity=entity).select(entity, "level", "stratum")
    return known.join(fixed, entity, "left_semi").withColumn("stratum", F.lit(None).cast("int")).unionByName(chosen)
