"""Blending of forecast arms by named weights.  Weights are never positional."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from monthgrid.hadoop import Files
from monthgrid.operators import order

# Weights of the trend, boosting and foundation arms by horizon; factory and calibrated.
FACTORY = {
    1: {"trend": 0.5741, "boost": 0.4258, "foundation": 0.0001},
    3: {"trend": 0.6876, "boost": 0.1934, "foundation": 0.1190},
    6: {"trend": 0.8220, "boost": 0.1779, "foundation": 0.0001},
    12: {"trend": 0.0, "boost": 1.0, "foundation": 0.0},
}
CALIBRATED = {
    1: {"trend": 0.563, "boost": 0.437, "foundation": 0.0},
    3: {"trend": 0.775, "boost": 0.084, "foundation": 0.141},
    6: {"trend": 0.85, "boost": 0.15, "foundation": 0.0},
    12: {"trend": 0.07, "boost": 0.93, "foundation": 0.0},
}
FAR = {"trend": 0.20, "boost": 0.75, "foundation": 0.05}
NEAR = {"trend": 0.45, "boost": 0.35, "foundation": 0.20}
FLOOR = 1e-6


def load_weights(path: str, factory: dict = FACTORY, spark=None) -> dict:
    """A weight file (horizon to named weights) over the factory's, each horizon scaled to a sum of one; with a session, from any
    file system it reads."""
    import json

    if spark is not None:
        text = Files(spark).read(path)
        if text is None:
            raise FileNotFoundError(path)
    else:
        with open(path) as f:
            text = f.read()
    given = {int(h): w for h, w in json.loads(text).items()}
    out = {}
    for h, w in (factory | given).items():
        if set(w) != {"trend", "boost", "foundation"} or min(w.values()) < 0 or sum(w.values()) <= 0:
            raise ValueError(f"horizon {h}: weights must name the three arms, none negative")
        out[h] = {arm: v / sum(w.values()) for arm, v in w.items()}
    return out


def weight(arm: str, horizon: Column, table: dict) -> Column:
    out = F.when(horizon >= 6, FAR[arm]).otherwise(NEAR[arm])
    for h, w in table.items():
        out = F.when(horizon == h, w[arm]).otherwise(out)
    return out


def regime_blend(rows: DataFrame, table: dict = CALIBRATED, *, lead: str = "lead_months", alert: str = "gate_alert", arms=("pred_trend", "pred_boost", "pred_foundation")) -> DataFrame:
    """rows with pred_blend and the weights used: in an alert the boosting arm has .70 (.80 from six months on) at
    least, and what is left goes .75 to the trend and .25 to the foundation arm."""
    h = F.col(lead)
    w = {a: weight(a, h, table) for a in ("trend", "boost", "foundation")}
    on = F.coalesce(F.col(alert), F.lit(False))
    boost = F.when(on, F.greatest(w["boost"], F.when(h >= 6, 0.80).otherwise(0.70))).otherwise(w["boost"])
    trend = F.when(on, (1 - boost) * 0.75).otherwise(w["trend"])
    foundation = F.when(on, (1 - boost) * 0.25).otherwise(w["foundation"])
    value = trend * F.col(arms[0]) + boost * F.col(arms[1]) + foundation * F.col(arms[2])
    return rows.withColumns({"w_trend": trend, "w_boost": boost, "w_foundation": foundation, "pred_blend": F.greatest(value, F.lit(FLOOR))})


def two_arm_gate(rows: DataFrame, calm: float = 0.40, alert: str = "gate_alert") -> DataFrame:
    """The boosting arm alone in an alert; else `calm` of the foundation arm."""
    a = F.when(F.coalesce(F.col(alert), F.lit(False)), 0.0).otherwise(calm)
    return rows.withColumns({"w_foundation": a, "pred_gated": F.greatest((1 - a) * F.col("pred_boost") + a * F.col("pred_foundation"), F.lit(0.0))})


def finite_rows(oof: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose columns are all finite numbers."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return oof.filter(ok)


def fit_two_arms(oof: DataFrame, *, low: float = 0.5, high: float = 1.0, raised: float = 0.70, default: float = 0.82) -> DataFrame:
    """(w_boost, mae): the weight of the boosting arm with the least mean absolute error, over the rows finite in the target
    and both arms; `default` without such rows.  The lower bound is raised when the foundation arm errs more than 1.5
    times as much.

    The error is a sum of |arms' difference| * |breakpoint - weight|, so its minimum is the weighted median of the
    breakpoints, and on an interval the nearest point to it: exact, without a search."""
    known = finite_rows(oof, ["target", "pred_boost", "pred_foundation"])
    d = F.col("pred_boost") - F.col("pred_foundation")
    points = known.filter(d != 0).select(((F.col("target") - F.col("pred_foundation")) / d).alias("value"), F.abs(d).alias("weight"))
    err = lambda e: F.avg(F.abs(F.col("target") - e))
    bounds = known.agg(F.when(err(F.col("pred_foundation")) > 1.5 * err(F.col("pred_boost")), F.greatest(F.lit(low), F.lit(raised))).otherwise(F.lit(low)).alias("bound"), F.count(F.lit(1)).alias("n"))
    middle = order.weighted_median(points, "value", "weight")
    # One row each.  Without two arms that differ, every weight errs alike.
    found = bounds.crossJoin(middle).select(
        F.when(F.col("n") == 0, F.lit(default)).otherwise(F.greatest("bound", F.least(F.coalesce("median", F.lit(default)), F.lit(high)))).alias("w_boost")
    )
    w = F.col("w_boost")
    rows = found.join(known, F.lit(True), "left")
    return rows.groupBy("w_boost").agg(err(w * F.col("pred_boost") + (1 - w) * F.col("pred_foundation")).alias("mae"))


def corner(planes: np.ndarray) -> tuple[np.ndarray, float]:
    """The point of the triangle (a, b at least 0, a + b at most 1) where the highest of the planes (c, ga, gb: c + ga a + gb b)
    is lowest, and its height there: the roof's lowest corner, where three of the planes or sides meet."""
    k = len(planes)
    left = np.vstack([np.column_stack([planes[:, 1:], -np.ones(k)]), [[1.0, 0, 0], [0, 1.0, 0], [1.0, 1.0, 0]]])
    right = np.concatenate([-planes[:, 0], [0.0, 0.0, 1.0]])
    pick = np.array(list(combinations(range(k + 3), 3)))
    a, b = left[pick], right[pick]
    good = np.abs(np.linalg.det(a)) > 1e-12 * np.abs(a).max(axis=(1, 2)) ** 2
    x = np.linalg.solve(a[good], b[good][..., None])[..., 0]
    x = x[(x[:, 0] >= -1e-12) & (x[:, 1] >= -1e-12) & (x[:, 0] + x[:, 1] <= 1 + 1e-12), :2]
    heights = (planes[:, 0] + x @ planes[:, 1:].T).max(axis=1)
    best = int(heights.argmin())
    return np.clip(x[best], 0, 1), float(heights[best])


def lowest(planes: np.ndarray, start: tuple[float, float], few: int = 12) -> tuple[np.ndarray, float]:
    """corner() of many planes: of those highest at `start`, and then of each that rises above the corner found."""
    planes = np.unique(planes, axis=0)
    height = lambda p: planes[:, 0] + planes[:, 1:] @ np.asarray(p)
    used = np.unique(np.concatenate([np.argsort(-height(start))[:few], [int(height(p).argmax()) for p in ((0, 0), (1, 0), (0, 1))]]))
    while True:
        p, low = corner(planes[used])
        above = height(p)
        most = int(above.argmax())
        if above[most] <= low + 1e-12 * max(1.0, abs(low)) or most in used:
            return p, low
        used = np.append(used, most)


def fit_simplex(oof: DataFrame, *, step: float = 0.1, lead: str = "lead_months", gap: float = 1e-9, rounds: int = 60) -> DataFrame:
    """(lead, w_trend, w_boost, w_foundation, mae, gap): per horizon the weights on the simplex with the least mean absolute
    error over the rows finite in all columns.

    The error is convex, so at any weights its slope gives a plane under it.  The first aggregate gives the errors and slopes on
    a coarse grid, and each further one those at the lowest point of all planes so far (for all horizons together),
    until the least error found is within `gap`, relatively, of that lowest point, which no weights can fall below.
    Only sums leave the tasks: a few numbers for each horizon and point."""
    arms = ["pred_trend", "pred_boost", "pred_foundation"]
    rows = finite_rows(oof, ["target", *arms])
    n = round(1 / step)
    points = {None: [(i / n, j / n) for i in range(n + 1) for j in range(n + 1 - i)]}
    best: dict = {}
    cuts: dict = {}
    floor: dict = {}
    open_ = None
    for _ in range(rounds):
        at = F.lit(None).cast("array<struct<a:double,b:double>>")
        asked = points.items() if open_ is None else [(h, points[h]) for h in open_]
        for h, ps in asked:
            made = F.array(*[F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in ps])
            at = made if h is None else F.when(F.col(lead) == h, made).otherwise(at)
        e = F.col("target") - (F.col("p.a") * F.col(arms[0]) + F.col("p.b") * F.col(arms[1]) + (1 - F.col("p.a") - F.col("p.b")) * F.col(arms[2]))
        slope = lambda arm: F.avg(-F.signum(F.col("e")) * (F.col(arm) - F.col(arms[2])))
        wanted = rows if open_ is None else rows.filter(F.col(lead).isin(*open_))
        found = (
            wanted.withColumn("p", F.explode(at)).withColumn("e", e).groupBy(lead, F.col("p.a").alias("a"), F.col("p.b").alias("b"))
            .agg(F.avg(F.abs("e")).alias("mae"), slope(arms[0]).alias("ga"), slope(arms[1]).alias("gb")).collect()
        )
        for r in found:
            h = r[lead]
            cuts.setdefault(h, []).append((r["mae"] - r["ga"] * r["a"] - r["gb"] * r["b"], r["ga"], r["gb"]))
            best[h] = min(best.get(h, (float("inf"),)), (r["mae"], -r["b"], -r["a"]))
        open_ = []
        for h, planes in cuts.items():
            p, height = lowest(np.array(planes), (-best[h][2], -best[h][1]))
            floor[h] = height
            if best[h][0] - height > gap * max(best[h][0], 1e-300):
                points[h] = [tuple(p)]
                open_.append(h)
        if not open_:
            break
    out = [(h, -m[2], -m[1], max(0.0, 1 + m[2] + m[1]), m[0], m[0] - floor[h]) for h, m in best.items()]
    kind = oof.schema[lead].dataType.simpleString()
    return oof.sparkSession.createDataFrame(out, f"{lead} {kind}, w_trend double, w_boost double, w_foundation double, mae double, gap double")
