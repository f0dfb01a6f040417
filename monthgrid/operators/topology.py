"""Topology of delay embeddings.

A window of five values makes three points of a delay embedding of dimension three; their finite bars are the two
shortest of the three distances, so the usual case is plain column arithmetic (`features`).  Other windows go through a
boundary-matrix reduction and an assignment (`wide_features`)."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.operators.windows import by
from monthgrid.session import dealt


def takens(x: np.ndarray, dimension: int = 3, delay: int = 1) -> np.ndarray:
    n = len(x) - (dimension - 1) * delay
    return np.array([x[i : i + dimension * delay : delay] for i in range(max(n, 0))])


def persistence(points: np.ndarray) -> dict[int, list[tuple[float, float]]]:
    """Finite bars of positive length of the Vietoris-Rips filtration, in degrees 0 and 1, over the field of two elements."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None, :]) ** 2).sum(-1)) if n else np.zeros((0, 0))
    simplices = [(0.0, (i,)) for i in range(n)]
    simplices += [(d[e], e) for e in combinations(range(n), 2)]
    simplices += [(max(d[a, b], d[a, c], d[b, c]), (a, b, c)) for a, b, c in combinations(range(n), 3)]
    simplices.sort(key=lambda s: (s[0], len(s[1]), s[1]))
    index = {s: i for i, (_, s) in enumerate(simplices)}
    low: dict[int, set] = {}
    bars: dict[int, list] = {0: [], 1: []}
    for j, (birth, s) in enumerate(simplices):
        column = {index[f] for f in combinations(s, len(s) - 1)} if len(s) > 1 else set()
        while column and max(column) in low:
            column ^= low[max(column)]
        if column:
            i = max(column)
            low[i] = column
            if len(simplices[i][1]) <= 2 and birth > simplices[i][0]:
                bars[len(simplices[i][1]) - 1].append((float(simplices[i][0]), float(birth)))
    return bars


def entropy(bars: list[tuple[float, float]]) -> float:
    life = np.array([b - a for a, b in bars])
    p = life / life.sum() if len(life) and life.sum() > 0 else np.empty(0)
    return float(-(p * np.log(p)).sum())


def assignment(cost: np.ndarray) -> np.ndarray:
    """For each row of a square matrix the column it is matched with at the least sum: rows enter one after another along
    shortest augmenting paths under potentials, a whole row of the matrix at a step."""
    n = len(cost)
    u, v = np.zeros(n + 1), np.zeros(n + 1)
    owner = np.zeros(n + 1, int)  # the row of each column, from 1; 0: free
    for i in range(1, n + 1):
        owner[0], col = i, 0
        short, back, done = np.full(n + 1, np.inf), np.zeros(n + 1, int), np.zeros(n + 1, bool)
        while owner[col]:
            done[col] = True
            reach = cost[owner[col] - 1] - u[owner[col]] - v[1:]
            closer = ~done[1:] & (reach < short[1:])
            short[1:][closer], back[1:][closer] = reach[closer], col
            col_next = 1 + int(np.where(done[1:], np.inf, short[1:]).argmin())
            step = short[col_next]
            u[owner[done]] += step
            v[done] -= step
            short[~done] -= step
            col = col_next
        while col:
            owner[col], col = owner[back[col]], back[col]
    out = np.empty(n, int)
    out[owner[1:] - 1] = np.arange(n)
    return out


def wasserstein(a: list, b: list) -> float:
    """The cheapest matching of two diagrams by the Euclidean metric: bars with bars, or bars with the diagonal.

    The matrix has a place on the diagonal for every bar of either side, and those match one another for nothing."""
    a, b = np.asarray(a, float).reshape(-1, 2), np.asarray(b, float).reshape(-1, 2)
    n, m = len(a), len(b)
    if not n + m:
        return 0.0
    cost = np.zeros((n + m, m + n))
    cost[:n, :m] = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
    cost[:n, m:] = ((a[:, 1] - a[:, 0]) / np.sqrt(2))[:, None]
    cost[n:, :m] = ((b[:, 1] - b[:, 0]) / np.sqrt(2))[None, :]
    return float(cost[np.arange(n + m), assignment(cost)].sum())


def diagram(window: np.ndarray, dimension: int = 3, delay: int = 1) -> list[tuple[float, float]]:
    """The bars of a window's delay embedding, its columns scaled by their population deviation: those of loops where there
    are any, else the finite ones of components."""
    points = takens(np.asarray(window, float), dimension, delay)
    if not len(points) or not np.isfinite(points).all():
        return []
    sd = points.std(axis=0)
    bars = persistence((points - points.mean(axis=0)) / np.where(sd > 1e-12, sd, 1.0))
    return bars[1] or bars[0]


def wide_features(df: DataFrame, value: str = "y", *, width: int = 12, dimension: int = 3, delay: int = 1) -> DataFrame:
    """`features` for windows of any width, and embeddings of any dimension and delay: tda_entropy and tda_distance of the
    window that ends one row before.  The distance is to the last window before it that has bars.

    A row brings its window as an array of `width` values, a bounded frame of its entity; diagrams and distances are made
    row by row in Arrow batches, so an entity of any length is never one group in memory."""
    pairs = "array<array<double>>"

    @F.pandas_udf(pairs)
    def bars_of(windows: pd.Series) -> pd.Series:
        return pd.Series([[list(map(float, bar)) for bar in diagram(x, dimension, delay)] if x is not None else None for x in windows])

    @F.pandas_udf("double")
    def distance(now: pd.Series, before: pd.Series) -> pd.Series:
        plain = lambda bars: [tuple(b) for b in bars]
        return pd.Series([wasserstein(plain(x), plain(y)) if x is not None and len(x) and y is not None else None for x, y in zip(now, before)])

    @F.pandas_udf("double")
    def entropy_of(bars: pd.Series) -> pd.Series:
        return pd.Series([entropy([tuple(b) for b in x]) if x is not None and len(x) else None for x in bars])

    w = by()
    frame = w.rowsBetween(1 - width, 0)
    rows = dealt(df.filter(F.col(value).isNotNull()), "mo").select("mo", "period", F.when(F.count(value).over(frame) == width, F.collect_list(F.col(value).cast("double")).over(frame)).alias("__w"))
    made = rows.select("mo", "period", bars_of("__w").alias("__bars"))
    some = F.when(F.size("__bars") > 0, F.col("__bars"))
    before = F.last(some, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    seen = made.select("mo", "period", "__bars", before.alias("__before"))
    now = seen.select("mo", "period", entropy_of("__bars").alias("__e"), distance("__bars", "__before").alias("__d"))
    return now.select("mo", "period", F.lag("__e").over(w).alias("tda_entropy"), F.lag("__d").over(w).alias("tda_distance"))


def short_bars(value: str, w) -> tuple[Column, Column]:
    """The two finite bars of the window of five values ending at a row (columns scaled by their population deviation)."""
    v = [F.lag(value, 4 - i).over(w) for i in range(5)]
    columns = [[v[i + j] for i in range(3)] for j in range(3)]
    scaled = []
    for c in columns:
        mean = (c[0] + c[1] + c[2]) / 3
        sd = F.sqrt(((c[0] - mean) ** 2 + (c[1] - mean) ** 2 + (c[2] - mean) ** 2) / 3)
        sd = F.when(sd > 1e-12, sd).otherwise(1.0)
        scaled.append([x / sd for x in c])
    far = lambda a, b: F.sqrt(sum(((c[a] - c[b]) ** 2 for c in scaled[1:]), (scaled[0][a] - scaled[0][b]) ** 2))
    d = F.array_sort(F.array(far(0, 1), far(0, 2), far(1, 2)))
    return d[0], d[1]


def features(df: DataFrame, value: str = "y") -> DataFrame:
    """Per entity and row of known value: tda_entropy and tda_distance of the window ending one row before.

    The distance of two two-bar diagrams (both born at 0) is the cheaper of matching the bars in order or across, or
    of sending bars to the diagonal."""
    w = by()
    rows = df.filter(F.col(value).isNotNull())
    a, b = short_bars(value, w)
    rows = rows.select("mo", "period", value, a.alias("__a"), b.alias("__b"))
    rows = rows.withColumns({"__pa": F.lag("__a").over(w), "__pb": F.lag("__b").over(w)})
    total = F.col("__a") + F.col("__b")
    part = lambda c: F.when(F.col(c) > 0, -(F.col(c) / total) * F.log(F.col(c) / total)).otherwise(0.0)
    away = lambda c: F.col(c) / F.sqrt(F.lit(2.0))
    gap = lambda x, y: F.least(F.abs(F.col(x) - F.col(y)), away(x) + away(y))
    distance = F.least(gap("__a", "__pa") + gap("__b", "__pb"), gap("__a", "__pb") + gap("__b", "__pa"))
    now = rows.select("mo", "period", F.when(total > 0, part("__a") + part("__b")).alias("__e"), F.when(F.col("__pa").isNotNull(), distance).alias("__d"))
    return now.select("mo", "period", F.lag("__e").over(w).alias("tda_entropy"), F.lag("__d").over(w).alias("tda_distance"))


def sigma_alert(df: DataFrame, c: str = "tda_distance", k: float = 2.5) -> Column:
    """A distance over mean + k sd of all its past (three values or more)."""
    f = W.partitionBy("mo").orderBy("period").rowsBetween(W.unboundedPreceding, -1)
    sd = F.stddev_samp(c).over(f)
    return F.coalesce((F.count(c).over(f) >= 3) & (sd >= 1e-10) & (F.col(c) > F.avg(c).over(f) + k * sd), F.lit(False))
