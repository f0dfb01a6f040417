"""Structural-break detectors.  What a window can say is a window; state that resets runs once for each entity."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.operators.windows import by, past, quantile
from monthgrid.session import dealt


def check_series(df: DataFrame, entity: str = "mo", period: str = "period", value: str = "y") -> DataFrame:
    """Per entity: whether its months are unique and contiguous and its values finite."""
    m = F.year(period) * 12 + F.month(period)
    return df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"), (F.count_distinct(period) == F.count(F.lit(1))).alias("unique_months"),
        ((F.max(m) - F.min(m) + 1) == F.count_distinct(period)).alias("contiguous"),
        (F.sum(F.when(F.col(value).isNull() | F.isnan(value) | (F.abs(F.col(value)) == float("inf")), 1).otherwise(0)) == 0).alias("finite"),
    )


def residual_barrier(df: DataFrame, *, window: int = 24, history: int = 4, k: float = 1.8, q: float = 0.9, residual: str = "residual") -> DataFrame:
    """|residual| over the smaller of mean + k sd and the q-quantile of its past; an alarm at 1 or more."""
    size = F.abs(F.col(residual))
    rows = df.withColumn("__size", size)
    f = past(by(), window)
    known = F.count("__size").over(f) >= history
    barrier = F.greatest(F.least(F.avg("__size").over(f) + k * F.stddev_samp("__size").over(f), quantile("__size", q, f)), F.lit(1e-8))
    rows = rows.withColumn("residual_score", F.when(known, F.col("__size") / barrier)).drop("__size")
    return rows.withColumns({"residual_eligible": F.col("residual_score").isNotNull(), "residual_shock": F.coalesce(F.col("residual_score") >= 1, F.lit(False))})


def residual_news(df: DataFrame, *, lookback: int = 2, alert: str = "news_alert", known: str = "news_eligible") -> DataFrame:
    """A residual strictly over its barrier with a news alert in this row or the `lookback` rows before."""
    f = by().rowsBetween(-lookback, 0)
    near = F.coalesce(F.max(F.col(alert).cast("int")).over(f), F.lit(0)) == 1
    able = F.col("residual_eligible") & (F.coalesce(F.max(F.col(known).cast("int")).over(f), F.lit(0)) == 1)
    return df.withColumns({"residual_news_eligible": able, "residual_news_shock": able & near & (F.col("residual_score") > 1)})


def distance_alert(df: DataFrame, c: str, *, window: int = 24, history: int = 4, q: float = 0.85) -> DataFrame:
    """A topological distance at or over the q-quantile of its past window (three known values or more)."""
    w = by()
    bar = quantile(c, q, past(w, window), 3)
    able = (F.row_number().over(w) - 1 >= history) & bar.isNotNull()
    return df.withColumns({"tda_eligible": F.coalesce(able, F.lit(False)), "tda_shock": F.coalesce(able & (F.col(c) >= bar), F.lit(False))})


def near_flag(df: DataFrame, flag: str, k: int) -> F.col:
    """Whether the flag is set within k rows either side."""
    return F.coalesce(F.max(F.col(flag).cast("int")).over(by().rowsBetween(-k, k)), F.lit(0)) == 1


def gate(df: DataFrame, flags: list[str]) -> DataFrame:
    """The alert that was known before the row: any flag of the entity's row before."""
    w = by()
    set_ = [F.coalesce(F.lag(c, 1).over(w), F.lit(False)) for c in flags]
    out = set_[0]
    for s in set_[1:]:
        out = out | s
    return df.withColumn("gate_alert", out)


def consensus(df: DataFrame) -> DataFrame:
    """cusum, or tda with pelt, or tda one calendar month earlier with news now."""
    before = df.select("mo", F.add_months("period", 1).alias("period"), F.col("tda_shock").alias("__tda"))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    joined = df.join(before, ["mo", "period"], "left")
    verdict = yes("cusum_shock") | (yes("tda_shock") & yes("pelt_shock")) | (yes("__tda") & yes("news_alert"))
    return joined.withColumn("consensus_shock", verdict).drop("__tda")


def alert_share(df: DataFrame, shock: str, eligible: str, period: str = "period") -> DataFrame:
    able = F.col(eligible).cast("int")
    return df.groupBy(period).agg(
        F.sum(able).cast("long").alias("eligible"),
        (F.sum((F.col(shock) & F.col(eligible)).cast("int")) / F.nullif(F.sum(able), F.lit(0))).alias("share"),
    )


def macro_events(shares: DataFrame, threshold: float = 0.085, period: str = "period", national: str | None = None) -> DataFrame:
    """Months whose share reaches the threshold (or with a national shock); of consecutive months, pairs in order
    keep the one of the larger share, of equals the earlier; a national shock counts like a share of 1 more, an unknown
    share like 0.  The ordering is over months only."""
    hit = F.coalesce(F.col("share") >= threshold, F.lit(False))
    if national:
        hit = hit | F.coalesce(F.col(national), F.lit(False))
    w = W.orderBy(period)
    rows = shares.filter(hit).withColumn("__island", (F.year(period) * 12 + F.month(period)) - F.row_number().over(w))
    inside = W.partitionBy("__island").orderBy(period)
    rows = rows.withColumn("__pair", F.floor((F.row_number().over(inside) - 1) / 2))
    weight = F.coalesce("share", F.lit(0.0)) + (F.coalesce(F.col(national), F.lit(False)).cast("double") if national else F.lit(0.0))
    best = F.max(F.struct(weight.alias("weight"), F.col("share"), (-(F.year(period) * 12 + F.month(period))).alias("earlier"), F.col(period).alias("event")))
    return rows.groupBy("__island", "__pair").agg(best.alias("b")).select(F.col("b.event").alias("event"), F.col("b.share").alias("share"))


def cusum_path(y: np.ndarray, *, history: int = 4, drift: float = 0.5, threshold: float = 2.0):
    """Scores and alarms of a two-sided CUSUM that starts again after each alarm; the scale is that of the start."""
    score, alarm = np.full(len(y), np.nan), np.zeros(len(y), bool)
    if len(y) > history:
        base = y[:history]
        mid, scale = base.mean(), max(base.std(ddof=1), 1e-8)
        high = low = 0.0
        for i in range(history, len(y)):
            z = (y[i] - mid) / scale
            high, low = max(0.0, high + z - drift), max(0.0, low - z - drift)
            score[i] = max(high, low) / threshold
            if score[i] >= 1:
                alarm[i], high, low = True, 0.0, 0.0
    return score, alarm


def cusum(df: DataFrame, value: str = "y", **options) -> DataFrame:
    """(mo, period, cusum_score, cusum_shock, cusum_eligible) of each entity's known values."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period")
        score, alarm = cusum_path(pdf[value].to_numpy(float), **options)
        return pd.DataFrame({"mo": pdf["mo"], "period": pdf["period"], "cusum_score": score, "cusum_shock": alarm, "cusum_eligible": ~np.isnan(score)})

    rows = df.filter(F.col(value).isNotNull()).select("mo", "period", value)
    made = dealt(rows, "mo").groupBy("mo").applyInPandas(run, "mo string, period date, cusum_score double, cusum_shock boolean, cusum_eligible boolean")
    return made.withColumn("cusum_score", F.when(~F.isnan("cusum_score"), F.col("cusum_score")))


def median_costs(x: np.ndarray) -> np.ndarray:
    """cost[i, j] = the absolute deviations of i..j-1 from their median: two heaps grow with the segment's end."""
    n = len(x)
    cost = np.full((n + 1, n + 1), np.inf)
    for i in range(n):
        low, high, below, above = [], [], 0.0, 0.0  # the lower half (negated) and the upper half, with their sums
        for j in range(i, n):
            v = float(x[j])
            if not low or v <= -low[0]:
                heapq.heappush(low, -v)
                below += v
            else:
                heapq.heappush(high, v)
                above += v
            if len(low) > len(high) + 1:
                v = -heapq.heappop(low)
                heapq.heappush(high, v)
                below, above = below - v, above + v
            elif len(high) > len(low):
                v = heapq.heappop(high)
                heapq.heappush(low, -v)
                below, above = below + v, above - v
            cost[i, j + 1] = above - below + (-low[0] if len(low) > len(high) else 0.0)
    return cost


def cost_matrix(x: np.ndarray, model: str) -> np.ndarray:
    """cost[i, j]: the cost of the segment i..j-1 under l1, l2 or rbf (median bandwidth); quadratic, from running sums."""
    n = len(x)
    if model == "l1":
        return median_costs(x)
    size = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    if model == "l2":
        x = x - x.mean() if n else x
        one, two = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x, x * x))
        apart = lambda s: s[None, :] - s[:, None]
        cost = np.maximum(apart(two) - apart(one) ** 2 / np.maximum(size, 1), 0.0)
    else:
        d = (x[:, None] - x[None, :]) ** 2
        med = np.median(d[np.triu_indices(n, 1)]) if n > 1 else 1.0
        g = np.exp(-np.clip(d / (med if med > 0 else 1.0), 1e-2, 1e2))
        np.fill_diagonal(g, 1.0)
        total = np.zeros((n + 1, n + 1))
        total[1:, 1:] = g.cumsum(0).cumsum(1)
        own = np.diag(total)
        cost = size - (own[None, :] - total - total.T + own[:, None]) / np.maximum(size, 1)
    return np.where(size > 0, cost, np.inf)


def optimal_breaks(x: np.ndarray, penalty: float, model: str = "rbf", size: int = 2, cost: np.ndarray | None = None) -> list[int]:
    """Boundaries of the partition with the least cost plus penalty for each boundary: exact, by dynamic programming; `cost` is
    the series' cost_matrix, where it is known already.

    A start i is pruned once its value at some boundary s is over that boundary's best plus a penalty: splitting at s is then
    better for every end that leaves `size` points after s, as costs never grow when a segment is split."""
    n, cost = len(x), cost_matrix(x, model) if cost is None else cost
    best, back = np.concatenate([[0.0], np.full(n, np.inf)]), [0] * (n + 1)
    starts, dead = [0], {}
    for j in range(size, n + 1):
        if j - size >= size:
            starts.append(j - size)
        gone = dead.pop(j, ())
        starts = [i for i in starts if i not in gone] if gone else starts
        at = np.array(starts)
        values = best[at] + cost[at, j] + np.where(at > 0, penalty, 0.0)
        for i, c in zip(starts, values):
            if c < best[j] - 1e-12:
                best[j], back[j] = c, i
        over = at[values > best[j] + penalty + 1e-9]
        if len(over):
            dead.setdefault(j + size, set()).update(over.tolist())
    out, j = [], n
    while j > 0 and back[j] > 0:
        j = back[j]
        out.append(j)
    return out[::-1]


def greedy_breaks(x: np.ndarray, penalty: float, model: str = "rbf", size: int = 2, cost: np.ndarray | None = None) -> list[int]:
    """Boundaries of binary segmentation: the split with the largest gain first (of equals the earliest), while the gain exceeds the
    penalty.  A segment's best split is found once, when the segment is made."""
    cost = cost_matrix(x, model) if cost is None else cost
    open_, found = [], []

    def offer(a: int, b: int) -> None:
        if b - a >= 2 * size:
            m = np.arange(a + size, b - size + 1)
            gains = cost[a, b] - cost[a, m] - cost[m, b]
            k = int(gains.argmax())
            heapq.heappush(open_, (-float(gains[k]), int(m[k]), a, b))

    offer(0, len(x))
    while open_ and -open_[0][0] > penalty:
        _, m, a, b = heapq.heappop(open_)
        found.append(m)
        offer(a, m)
        offer(m, b)
    return sorted(found)


def online_breaks(y: np.ndarray, *, method: str = "pelt", window: int = 24, history: int = 4, penalty: float = 2.5, size: int = 2, model: str = "rbf"):
    """At each step the breaks of the past window; a boundary is reported once, while at most `size` points follow it."""
    n = len(y)
    shock, score, at, told = np.zeros(n, bool), np.full(n, np.nan), np.full(n, -1), set()
    for i in range(n):
        start = max(0, i - window + 1)
        x = y[start : i + 1]
        if len(x) <= max(history, 2 * size):
            continue
        past_ = x[:-1]
        x = (x - past_.mean()) / max(past_.std(ddof=1), 1e-8)
        pen = min(penalty, max(0.5, 0.35 * np.log(len(x))))
        score[i] = 0.0
        breaks = (optimal_breaks if method == "pelt" else greedy_breaks)(x, pen, model, size)
        fresh = [b for b in breaks if len(x) - b <= size and start + b not in told]
        if fresh:
            b = fresh[-1]
            told.add(start + b)
            shock[i], at[i] = True, start + b
            score[i] = abs(x[b:].mean() - x[:b].mean())
    return shock, score, at


def window_costs(x: np.ndarray, model: str) -> np.ndarray:
    """The cost matrix of each row of x, as cost_matrix makes it; all rows at once but under l1."""
    w, n = x.shape
    if model == "l1":
        return np.stack([median_costs(v) for v in x])
    size = np.arange(n + 1)[None, :] - np.arange(n + 1)[:, None]
    if model == "l2":
        x = x - x.mean(axis=1, keepdims=True)
        one, two = (np.concatenate([np.zeros((w, 1)), np.cumsum(v, axis=1)], axis=1) for v in (x, x * x))
        apart = lambda s: s[:, None, :] - s[:, :, None]
        cost = np.maximum(apart(two) - apart(one) ** 2 / np.maximum(size, 1), 0.0)
    else:
        d = (x[:, :, None] - x[:, None, :]) ** 2
        med = np.median(d[:, *np.triu_indices(n, 1)], axis=1)
        g = np.exp(-np.clip(d / np.where(med > 0, med, 1.0)[:, None, None], 1e-2, 1e2))
        g[:, np.arange(n), np.arange(n)] = 1.0
        total = np.zeros((w, n + 1, n + 1))
        total[:, 1:, 1:] = g.cumsum(1).cumsum(2)
        own = np.diagonal(total, axis1=1, axis2=2)
        cost = size - (own[:, None, :] - total - total.transpose(0, 2, 1) + own[:, :, None]) / np.maximum(size, 1)
    return np.where(size > 0, cost, np.inf)


def last_breaks(x: np.ndarray, penalty: float, model: str = "rbf", size: int = 2) -> np.ndarray:
    """The last boundary of each row's optimal partition, 0 without any: optimal_breaks for many rows of one length."""
    w, n = x.shape
    cost = np.ascontiguousarray(window_costs(x, model).transpose(1, 2, 0))
    best, back = np.full((n + 1, w), np.inf), np.zeros((n + 1, w), np.int64)
    best[0] = 0.0
    for j in range(size, n + 1):
        for i in (0, *range(size, j - size + 1)):
            c = best[i] + cost[i, j] + (penalty if i else 0.0)
            less = c < best[j] - 1e-12
            best[j][less], back[j][less] = c[less], i
    return back[n]


def online_pelt(y: np.ndarray, place: np.ndarray, told: np.ndarray, *, window: int = 24, history: int = 4, penalty: float = 2.5, size: int = 2, model: str = "rbf", most: int = 2048):
    """online_breaks under pelt for many series one after another, at the steps `told`; place: the number of each value in its
    series.  All windows of one length are segmented together, `most` at a time.

    A boundary has `size` points behind it at least and is told while `size` follow it at most, so it is the last one, `size`
    before the end, and no two steps have the same."""
    n = len(y)
    shock, score, at = np.zeros(n, bool), np.full(n, np.nan), np.full(n, -1)
    length = np.minimum(place + 1, window)
    asked = told & (length > max(history, 2 * size))
    for k in np.unique(length[asked]).tolist():
        of = np.flatnonzero(asked & (length == k))
        pen = min(penalty, max(0.5, 0.35 * np.log(k)))
        for lo in range(0, len(of), most):
            i = of[lo : lo + most]
            x = y[i[:, None] + np.arange(1 - k, 1)]
            past_ = np.ascontiguousarray(x[:, :-1])
            x = (x - past_.mean(axis=1, keepdims=True)) / np.maximum(past_.std(axis=1, ddof=1, keepdims=True), 1e-8)
            found = last_breaks(x, pen, model, size) == k - size  # never at 0, as k > 2 * size
            score[i] = np.where(found, np.abs(x[:, k - size :].mean(axis=1) - x[:, : k - size].mean(axis=1)), 0.0)
            shock[i], at[i] = found, np.where(found, place[i] + 1 - size, -1)
    return shock, score, at


def segmentation(df: DataFrame, method: str = "pelt", value: str = "y", **options) -> DataFrame:
    """(mo, period, shock, score, eligible, break_period) of each entity's known values, each step seeing its past only.

    Under pelt a task's entities go through together, some batches of sorted rows at a time; of the last one of these, which
    may go on, the rows that its next windows reach are kept."""
    columns = ["mo", "period", *(f"{method}_{c}" for c in ("shock", "score", "eligible", "break_period"))]
    kind = f"mo string, period date, {method}_shock boolean, {method}_score double, {method}_eligible boolean, {method}_break_period date"
    rows = df.filter(F.col(value).isNotNull()).select(F.col("mo").cast("string").alias("mo"), "period", F.col(value).cast("double").alias(value))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period").reset_index(drop=True)
        shock, score, at = online_breaks(pdf[value].to_numpy(float), method=method, **options)
        where = [pdf["period"][a] if a >= 0 else None for a in at]
        return pd.DataFrame(dict(zip(columns, (pdf["mo"], pdf["period"], shock, score, ~np.isnan(score), where))))

    def together(batches):
        kept = None  # the last rows of the batches before
        for batch in batches:
            new = pa.Table.from_batches([batch])
            own = pa.concat_tables([kept, new]) if kept is not None else new
            mo = own.column("mo").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy()
            here = np.arange(len(mo))
            first = np.maximum.accumulate(np.where(np.concatenate(([True], mo[1:] != mo[:-1])), here, 0)) if len(mo) else here
            told = here >= len(mo) - len(new)  # those kept have their results already
            shock, score, at = online_pelt(own.column(value).to_numpy(), here - first, told, **options)
            when = own.column("period").take(pa.array(np.where(at >= 0, first + at, 0)[told], mask=~shock[told]))
            out = [own.column("mo").filter(pa.array(told)), own.column("period").filter(pa.array(told)), pa.array(shock[told]), pa.array(score[told]), pa.array(~np.isnan(score[told])), when]
            yield from pa.table(dict(zip(columns, out))).to_batches()
            if len(mo):
                kept = own.slice(max(int(first[-1]), len(mo) - options.get("window", 24) + 1))

    if method == "pelt":
        made = dealt(rows, "mo").sortWithinPartitions("mo", "period").mapInArrow(together, kind)
    else:
        made = dealt(rows, "mo").groupBy("mo").applyInPandas(each, kind)
    return made.withColumn(f"{method}_score", F.when(~F.isnan(f"{method}_score"), F.col(f"{method}_score")))


def retrospective(series: DataFrame, value: str = "y", models=("l1", "l2", "rbf"), penalties=(0.5, 1.0, 2.5)) -> DataFrame:
    """Every model, penalty and method over one whole series, scaled by its population deviation.  A model is one group: its cost
    matrix, which neither penalty nor method changes, is made once."""
    spark = series.sparkSession
    grid = spark.createDataFrame([(m,) for m in models], "model string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("period").reset_index(drop=True)
        x = pdf[value].to_numpy(float)
        x = (x - x.mean()) / max(x.std(), 1e-8)
        model, out = pdf["model"][0], []
        cost = cost_matrix(x, model)
        for name, algorithm in (("pelt", optimal_breaks), ("binseg", greedy_breaks)):
            out += [(name, model, float(p), pdf["period"][b]) for p in penalties for b in algorithm(x, p, model, cost=cost)]
        return pd.DataFrame(out, columns=["algorithm", "model", "penalty", "break_period"])

    rows = series.filter(F.col(value).isNotNull()).select("period", value)
    return rows.join(F.broadcast(grid)).groupBy("model").applyInPandas(run, "algorithm string, model string, penalty double, break_period date")


def match_events(detections: DataFrame, events: DataFrame, tolerance: int = 31) -> DataFrame:
    """(method, detected, event, delay) of a one-to-one greedy matching: closest first, then the earlier detection,
    then the earlier event.  Candidates come from a join on near months; each method is matched by itself."""
    e = events.select(F.col("event").alias("__e"), F.explode(F.expr(f"sequence(-{tolerance // 28 + 1}, {tolerance // 28 + 1})")).alias("__d"))
    e = e.withColumn("__m", F.trunc(F.add_months("__e", F.col("__d")), "month"))
    near = detections.select("method", "detected", F.trunc("detected", "month").alias("__m")).distinct().join(F.broadcast(e), "__m")
    near = near.select("method", "detected", F.col("__e").alias("event"), F.datediff("detected", "__e").alias("delay")).filter(F.abs("delay") <= tolerance).distinct()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.assign(far=pdf["delay"].abs()).sort_values(["far", "detected", "event"])
        used_d, used_e, keep = set(), set(), []
        for i, d, e_ in zip(pdf.index, pdf["detected"], pdf["event"]):
            if d not in used_d and e_ not in used_e:
                used_d.add(d), used_e.add(e_), keep.append(i)
        return pdf.loc[keep, ["method", "detected", "event", "delay"]]

    return near.groupBy("method").applyInPandas(run, "method string, detected date, event date, delay int")


def event_scores(detections: DataFrame, events: DataFrame, tolerance: int = 31, methods: list[str] = (), observed: DataFrame | None = None) -> DataFrame:
    """Precision, recall, F1, coverage, mean lead (days, negative: early) and mean delay (months, early ones as 0) of each
    method; those of `methods` without a detection score 0.  With `observed` (its column `period`), only events
    between its first and last month count; out_of_range tells how many others there are."""
    span = observed.agg(F.min("period").alias("__lo"), F.max("period").alias("__hi")) if observed is not None else None
    inside = events if span is None else events.join(F.broadcast(span), F.col("event").between(F.col("__lo"), F.col("__hi")), "left_semi")
    matched = match_events(detections, inside, tolerance)
    m = matched.groupBy("method").agg(
        F.count(F.lit(1)).alias("matched"), F.avg("delay").alias("mean_lead_days"), (F.avg(F.greatest("delay", F.lit(0))) / 30.4375).alias("mean_delay")
    )
    d = detections.groupBy("method").agg(F.count_distinct("detected").alias("detected"))
    if methods:
        named = detections.sparkSession.createDataFrame([(x,) for x in methods], "method string")
        d = named.join(d, "method", "full").withColumn("detected", F.coalesce("detected", F.lit(0).cast("bigint")))
    catalog = events.agg(F.count_distinct("event").alias("catalog"))
    n = inside.agg(F.count_distinct("event").alias("events")).crossJoin(catalog)  # one row each
    rows = d.join(m, "method", "left").crossJoin(F.broadcast(n)).withColumn("matched", F.coalesce("matched", F.lit(0)))
    part = lambda whole: F.when(F.col(whole) > 0, F.col("matched") / F.col(whole)).otherwise(0.0)
    p, r = part("detected"), part("events")
    return rows.select("method", "detected", "matched", "events", (F.col("catalog") - F.col("events")).alias("out_of_range"), "mean_lead_days", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (100 * r).alias("coverage"), "mean_delay")
