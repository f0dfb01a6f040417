"""Exact order statistics that don't end in one task: ranks and quantiles from counts of distinct values.

A percentile without a key keeps every distinct value in one task's map.  Here values are counted first, the counted
values are cut into bins by the edges of an approximate sketch (the edges decide only how the work is spread, never the
result), and only bins are ordered against each other.  NULL and NaN are not values.  Frames without values give no row
(a keyed quantile) or NULL (one without a key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bins of one key, in groups: a value finds its group, then its bin there, by two short scans.
GROUPS, EACH = 16, 16


def spread(rows: DataFrame, c: str, keys: list[str]) -> tuple[DataFrame, int]:
    """(keys, edges), and about how many distinct values the largest key has: some GROUPS * EACH edges of the values of each
    key.  They are brought to the driver once and stay as they are, so that every use of them sees the same (a sketch may
    differ between runs): keys times 256 numbers."""
    n = GROUPS * EACH
    marks = F.array(*[F.lit(k / n) for k in range(1, n)])
    made = rows.groupBy(*keys).agg(F.percentile_approx(c, marks, 10 * n).alias("edges"), F.approx_count_distinct(c).alias("values")).filter("edges is not null").collect()
    kept = [[*row[: len(keys)], sorted(float(e) for e in row["edges"])] for row in made]
    names = [f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys]
    return rows.sparkSession.createDataFrame(kept, ", ".join([*names, "edges array<double>"])), max((row["values"] for row in made), default=0)


def bin_of(value: Column, edges: Column) -> Column:
    """How many of the sorted edges are under the value, found by group first."""
    v = value.cast("double")
    group = F.size(F.filter(F.sequence(F.lit(1), F.lit(GROUPS - 1)), lambda g: F.get(edges, g * EACH - 1) < v))
    within = F.size(F.filter(F.slice(edges, group * EACH + 1, F.lit(EACH)), lambda e: e < v))
    return group * EACH + within


def known(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.col(c).alias("value")).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def counted(rows: DataFrame, edges: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(keys, value, n, bin, offset, total): each distinct value with its count, its bin, the rows in the bins before, and
    the rows of its key."""
    counts = rows.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("n"))
    same = [counts[k].eqNullSafe(edges[k]) for k in keys]
    # A row for each key, of 2 kB: Spark broadcasts it while its size, which is known here, allows.
    joined = counts.join(edges, same) if keys else counts.crossJoin(F.broadcast(edges))
    binned = joined.select(*[counts[k] for k in keys], "value", "n", bin_of(F.col("value"), F.col("edges")).alias("bin"))
    sizes = binned.groupBy(*keys, "bin").agg(F.sum("n").alias("__size"))
    w = W.partitionBy(*keys)
    before = F.sum("__size").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    places = sizes.select(*keys, "bin", "__size", F.coalesce(before, F.lit(0)).alias("offset"), F.sum("__size").over(w).alias("total"))
    right = places.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bin").alias("__bin"), "__size", "offset", "total")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("bin") == F.col("__bin")]
    return binned.join(right, on).select(*keys, "value", "n", "bin", "offset", "total", "__size")


def ranked(df: DataFrame, c: str) -> DataFrame:
    """(value, rank): the average rank of every distinct value, from 1."""
    rows = known(df, c, [])
    within = F.sum("n").over(W.partitionBy("bin").orderBy("value").rowsBetween(W.unboundedPreceding, -1))
    return counted(rows, spread(rows, "value", [])[0]).select("value", (F.col("offset") + F.coalesce(within, F.lit(0)) + (F.col("n") + 1) / 2.0).alias("rank"))


def quantiles(df: DataFrame, c: str, qs: list[float], keys: list[str] = (), small: int = 200_000) -> DataFrame:
    """(keys, q): the linearly interpolated quantiles of each key as an array in the order of qs.  Where no key has more than
    `small` distinct values, counted before, their map fits one task and one aggregate serves; else values are binned and
    only the bins that hold a wanted rank are sorted.  Both are exact."""
    keys = list(keys)
    rows = known(df, c, keys)
    edges, most = spread(rows, "value", keys)
    if most <= small:
        return rows.groupBy(*keys).agg(F.expr(f"percentile(value, array({', '.join(repr(float(q)) for q in qs)}))").alias("q"))
    rows = counted(rows, edges, keys)
    low = lambda q: F.floor((F.col("total") - 1) * F.lit(float(q)))
    high = lambda q: F.ceil((F.col("total") - 1) * F.lit(float(q)))
    inside = lambda at: (at >= F.col("offset")) & (at < F.col("offset") + F.col("__size"))
    wanted = F.lit(False)
    for q in qs:
        wanted = wanted | inside(low(q)) | inside(high(q))
    to = F.col("offset") + F.sum("n").over(W.partitionBy(*keys, "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.filter(wanted).withColumn("__to", to)
    at = lambda place: F.min(F.when(F.col("__to") > place, F.col("value")))
    picked = rows.groupBy(*keys).agg(F.max("total").alias("total"), *[at(low(q)).alias(f"__l{i}") for i, q in enumerate(qs)], *[at(high(q)).alias(f"__h{i}") for i, q in enumerate(qs)])
    part = lambda i, q: F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * ((F.col("total") - 1) * F.lit(float(q)) - low(q))
    return picked.select(*keys, F.array(*[part(i, q) for i, q in enumerate(qs)]).alias("q"))


def median(df: DataFrame, c: str, name: str, keys: list[str] = ()) -> DataFrame:
    """(keys, name): the exact median of each key."""
    return quantiles(df, c, [0.5], keys).select(*keys, F.col("q")[0].alias(name))


def quantiles_of(df: DataFrame, columns: list[str], qs: list[float], keys: list[str] = (), small: int = 200_000) -> DataFrame:
    """(keys, column, q): the quantiles of many columns at once.  Values are tagged by their column and go through one count and
    one selection, so the number of jobs doesn't depend on the number of columns."""
    keys = list(keys)
    tagged = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns]))
    rows = df.select(*keys, tagged.alias("__t")).select(*keys, "__t.column", "__t.v")
    return quantiles(rows, "v", qs, [*keys, "column"], small)


def wide(found: DataFrame, columns: list[str], names, keys: list[str] = ()) -> DataFrame:
    """quantiles_of as one row for each key; names(column, i) names the i-th quantile, NULL where a column has no value."""
    n = [(c, i, name) for c in columns for i, name in enumerate(names(c))]
    picked = [F.max(F.when(F.col("column") == c, F.col("q")[i])).alias(name) for c, i, name in n]
    return (found.groupBy(*keys) if keys else found.groupBy()).agg(*picked)


def weighted_median(df: DataFrame, value: str, weight: str, keys: list[str] = ()) -> DataFrame:
    """(keys, median): the least value at which the weights of all values up to it reach half of their sum.

    Weights of equal values are summed first; the sums of bins tell which bin holds the median, and only that one is
    sorted.  Rows whose value or weight is unknown, and weights that aren't positive, don't count."""
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("value"), F.col(weight).cast("double").alias("__w"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("__w") > 0))
    edges, _ = spread(rows, "value", keys)
    sums = rows.groupBy(*keys, "value").agg(F.sum("__w").alias("__w"))
    same = [sums[k].eqNullSafe(edges[k]) for k in keys]
    joined = sums.join(edges, same) if keys else sums.crossJoin(F.broadcast(edges))
    binned = joined.select(*[sums[k] for k in keys], "value", "__w", bin_of(F.col("value"), F.col("edges")).alias("bin"))
    w = W.partitionBy(*keys)
    sizes = binned.groupBy(*keys, "bin").agg(F.sum("__w").alias("__size"))
    before = F.sum("__size").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1))
    places = sizes.select(*keys, "bin", "__size", F.coalesce(before, F.lit(0.0)).alias("__before"), (F.sum("__size").over(w) / 2).alias("__half"))
    # Sums of doubles may differ in their last bits by their order, so the bin next to the middle comes along.
    near = F.col("__half") * 1e-9
    wanted = places.filter((F.col("__before") <= F.col("__half") + near) & (F.col("__before") + F.col("__size") >= F.col("__half") - near))
    right = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("bin").alias("__bin"), "__before", "__half")
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys] + [F.col("bin") == F.col("__bin")]
    up_to = F.col("__before") + F.sum("__w").over(W.partitionBy(*keys, "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    reached = binned.join(right, on).withColumn("__to", up_to).filter(F.col("__to") >= F.col("__half") * (1 - 1e-12))
    return (reached.groupBy(*keys) if keys else reached.groupBy()).agg(F.min("value").alias("median"))


def prefix_medians(counts: DataFrame, at: str, value: str, n: str, places: list) -> DataFrame:
    """(at, median): for each of `places` (sorted) the median of all values of rows whose `at` is before it.

    counts: distinct (at, value) with their number n.  A table of bins by places, summed along the places, tells for each of
    them which bins hold its two middle ranks; only these bins' values are then looked at, so with b bins and m places the
    rows handled are 2 m / b times the counts, however long the history of a place is."""
    if not places:
        return counts.select(F.col(at), F.col(value).cast("double").alias("median")).limit(0)
    later = F.array(*[F.lit(p) for p in places])
    rows = counts.select(F.col(value).cast("double").alias("value"), F.col(n).alias("n"), F.size(F.filter(later, lambda p: p <= F.col(at))).alias("next")).filter(F.col("next") < len(places))
    found = spread(rows, "value", [])[0].collect()  # one row, which the driver has made
    if not found:
        return counts.select(F.col(at), F.col(value).cast("double").alias("median")).limit(0)
    edges = F.array(*[F.lit(e) for e in found[0]["edges"]])
    binned = rows.select("value", "n", "next", bin_of(F.col("value"), edges).alias("bin"))
    cells = binned.groupBy("bin", "next").agg(F.sum("n").alias("n"))
    # Every bin with every place: 256 times as many cells as places.
    full = cells.select("bin").distinct().select("bin", F.explode(F.sequence(F.lit(0), F.lit(len(places) - 1))).alias("place"))
    known = full.join(cells.withColumnRenamed("next", "place"), ["bin", "place"], "left")
    size = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy("bin").orderBy("place").rowsBetween(W.unboundedPreceding, 0))
    sized = known.select("bin", "place", size.alias("size"))
    w = W.partitionBy("place")
    before = F.coalesce(F.sum("size").over(w.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = sized.select("bin", "place", "size", before.alias("before"), F.sum("size").over(w).alias("total"))
    low, high = F.floor((F.col("total") - 1) / 2), F.ceil((F.col("total") - 1) / 2)
    inside = lambda rank: (rank >= F.col("before")) & (rank < F.col("before") + F.col("size"))
    asked = ranks.filter((F.col("total") > 0) & (inside(low) | inside(high))).select("bin", "place", "before", low.alias("low"), high.alias("high"))
    close = binned.join(asked, "bin").filter(F.col("next") <= F.col("place"))
    to = F.col("before") + F.sum("n").over(W.partitionBy("place", "bin").orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    first = lambda rank: F.min(F.when(F.col("__to") > F.col(rank), F.col("value")))
    middle = close.withColumn("__to", to).groupBy("place").agg(((first("low") + first("high")) / 2).alias("median"))
    return middle.select(F.get(later, F.col("place")).alias(at), "median")
