"""Forecast arms.  Substitutes for absent libraries say so in `model` and `mode`."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import product

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.functions.numbers import growth, ratio
from monthgrid.operators import order
from monthgrid.session import assert_none, dealt, forget, materialized


def design(u: np.ndarray, knots: np.ndarray) -> np.ndarray:
    """Level, slope, and the slope's changes after each knot."""
    return np.column_stack([np.ones_like(u), u] + [np.clip(u - k, 0, None) for k in knots])


def best_line(a: np.ndarray, v: np.ndarray, sigma: float, wide: float, scale: float) -> np.ndarray:
    """The minimum of |v - a b|^2 / (2 sigma^2) + (b0^2 + b1^2) / (2 wide^2) + sum |b2..| / scale, exactly: the sign of each
    slope change is -, 0 or +, each choice leaves a linear system, and the one that agrees with its signs is the minimum."""
    h = a.T @ a / sigma**2
    h[[0, 1], [0, 1]] += 1 / wide**2
    g = a.T @ v / sigma**2
    best, least = np.zeros(a.shape[1]), np.inf
    for signs in product((0, 1, -1), repeat=a.shape[1] - 2):
        s = np.array((0, 0, *signs), float)
        on = np.concatenate(([True, True], s[2:] != 0))
        b = np.zeros(a.shape[1])
        b[on] = np.linalg.solve(h[np.ix_(on, on)], (g - s / scale)[on])
        off = np.abs(h @ b - g)[~on].max(initial=0.0) - 1 / scale
        # Right up to rounding: changes have the sign assumed, and where none is, the pull is too weak for one.
        wrong = max(off * scale, -(b * s)[2:].min(initial=0.0))
        if wrong < least:
            best, least = b, wrong
        if wrong <= 1e-9:
            break
    return best


def trend_loss(a: np.ndarray, v: np.ndarray, b: np.ndarray, sigma: float, wide: float, scale: float, noise: float) -> float:
    """Minus the log posterior: normal errors of scale sigma, a normal prior on level and slope, a Laplace prior on slope
    changes, a half-normal one on sigma."""
    return len(v) * np.log(sigma) + ((v - a @ b) ** 2).sum() / (2 * sigma**2) + (b[:2] ** 2).sum() / (2 * wide**2) + np.abs(b[2:]).sum() / scale + sigma**2 / (2 * noise**2)


def trend_fit(t: np.ndarray, y: np.ndarray, changes: int = 2, scale: float = 0.05, share: float = 0.8, wide: float = 5.0, noise: float = 0.5):
    """A piecewise-linear trend at its posterior's maximum, as a function of t, with its parameters (beta, sigma, loss) as
    attributes.  Times become 0 to 1, values are divided by the largest; knots lie at the observed times that cut the first
    `share` of the rows into equal parts.  Level, slope and changes are the exact minimum for a given scale of errors, and
    that scale has a closed form for given errors; both in turn never raise the loss, from three starts."""
    size = max(np.abs(y).max(), 1e-8)
    start, span = t.min(), max(t.max() - t.min(), 1.0)
    u, v = (t - start) / span, y / size
    last = int(np.floor(len(t) * share)) - 1
    changes = max(0, min(changes, last))
    if changes > 6:
        raise ValueError("at most six changes: their signs are tried out")
    knots = u[np.round(np.linspace(0, last, changes + 1)).astype(int)[1:]] if changes else np.empty(0)
    a, n = design(u, knots), len(v)
    found = None
    for sigma in (max(float(np.std(v)), 1e-3), 0.1, 1e-3):
        before = np.inf
        for _ in range(200):
            b = best_line(a, v, sigma, wide, scale)
            rest = ((v - a @ b) ** 2).sum()
            # The positive root of 1 / noise^2 x^2 + n x - rest for x = sigma^2.
            sigma = max(np.sqrt(2 * rest / (n + np.sqrt(n * n + 4 * rest / noise**2))), 1e-6)
            loss = trend_loss(a, v, b, sigma, wide, scale, noise)
            if before - loss <= 1e-12 * max(1.0, abs(loss)):
                break
            before = loss
        b = best_line(a, v, sigma, wide, scale)
        loss = trend_loss(a, v, b, sigma, wide, scale, noise)
        if found is None or loss < found[2] - 1e-12:
            found = b, sigma, loss
    beta = found[0]

    def at(x):
        return design((np.asarray(x, float) - start) / span, knots) @ beta * size

    at.beta, at.sigma, at.loss = found
    at.matrix, at.scaled = a, v
    return at


def trend_arm(history: DataFrame, future: DataFrame, entity: str = "mo", period: str = "period", value: str = "y", most_fallbacks: float = 0.05) -> DataFrame:
    """(entity, period, pred, model, mode) for the months of `future`, fitted on each entity's history; under three
    known values, or where a fit fails, the last value.  More than `most_fallbacks` of the entities fail the whole, so the
    fits are written before they are looked at, and each is made once."""
    index = lambda s: pd.DatetimeIndex(s).year.to_numpy() * 12 + pd.DatetimeIndex(s).month.to_numpy()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        past = pdf[pdf["kind"] == 0].dropna(subset=["v"]).sort_values("p")
        ahead = pdf[pdf["kind"] == 1].sort_values("p")
        y, mode = past["v"].to_numpy(float), "fit"
        try:
            if len(y) < 3 or not len(ahead):
                raise ValueError("too short")
            pred = trend_fit(index(past["p"]).astype(float), y)(index(ahead["p"]))
        except (ValueError, np.linalg.LinAlgError):
            pred, mode = np.full(len(ahead), y[-1] if len(y) else 0.0), "fallback_last_value"
        return pd.DataFrame({"e": ahead["e"], "p": ahead["p"], "pred": pred, "model": "piecewise_linear_trend", "mode": mode})

    rows = history.select(F.col(entity).alias("e"), F.col(period).alias("p"), F.col(value).alias("v"), F.lit(0).alias("kind")).unionByName(
        future.select(F.col(entity).alias("e"), F.col(period).alias("p"), F.lit(None).cast("double").alias("v"), F.lit(1).alias("kind"))
    )
    out = dealt(rows, "e").groupBy("e").applyInPandas(run, "e string, p date, pred double, model string, mode string")
    out = out.withColumnsRenamed({"e": entity, "p": period})
    if most_fallbacks < 1:
        out = materialized(out, "trend")
        fallback_share(out, entity, most_fallbacks)
    return out


def fallback_share(predictions: DataFrame, entity: str = "mo", most: float = 0.05) -> float:
    """The share of entities on a fallback; an error over `most`."""
    row = predictions.groupBy(entity).agg(F.max((F.col("mode") != "fit").cast("double")).alias("f")).agg(F.avg("f")).first()
    if (row[0] or 0.0) > most:
        raise ValueError(f"{row[0]:.1%} of the entities fell back to their last value")
    return row[0] or 0.0


def filled_in(medians: dict[str, float | None], prefix: str = "__"):
    """A stage that gives each column its prefixed double, a missing or infinite one the median (0 without one)."""
    from pyspark.ml.feature import SQLTransformer

    full = lambda c: f"CASE WHEN `{c}` IS NOT NULL AND NOT isnan(`{c}`) AND abs(`{c}`) <> double('infinity') THEN double(`{c}`) END"
    each = ", ".join(f"coalesce({full(c)}, {float(m) if m is not None else 0.0!r}D) AS `{prefix}{c}`" for c, m in medians.items())
    return SQLTransformer(statement=f"SELECT *, {each} FROM __THIS__")


def boosting_model(train: DataFrame, columns: list[str], *, target: str = "target", trees: int = 20, depth: int = 4, rate: float = 0.1):
    """A fitted pipeline (missing features to training medians, vectors, gradient-boosted trees on log1p of the target under
    absolute loss, predictions at least 1e-6 as `pred`) that `save` keeps and PipelineModel.load brings back."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rows = materialized(train.select(*dict.fromkeys([*columns, target])), "training")
    row = order.wide(order.quantiles_of(rows, columns, [0.5]), columns, lambda c: [f"__{c}"]).first()
    fill = filled_in({c: row[f"__{c}"] for c in columns})
    vectors = VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__x")
    known = rows.filter(F.col(target).isNotNull()).withColumn("__y", F.log1p(F.greatest(F.col(target), F.lit(0.0))))
    known = vectors.transform(fill.transform(known)).select("__x", "__y")
    trees = GBTRegressor(featuresCol="__x", labelCol="__y", predictionCol="__p", lossType="absolute", maxIter=trees, maxDepth=depth, stepSize=rate, seed=7).fit(known)
    forget(rows)
    last = SQLTransformer(statement="SELECT *, greatest(expm1(__p), 1e-6D) AS pred FROM __THIS__")
    return PipelineModel([fill, vectors, trees, last])


def fit_boosting(train: DataFrame, columns: list[str], **options) -> Callable[[DataFrame], DataFrame]:
    """A function that gives rows their pred by a boosting_model fitted on train."""
    model = boosting_model(train, columns, **options)
    return lambda rows: model.transform(rows).select(*rows.columns, "pred", F.lit("spark_gbt").alias("model"))


def boosting_arm(train: DataFrame, test: DataFrame, columns: list[str], **options) -> DataFrame:
    """test with pred of a model fitted on train (see boosting_model)."""
    return fit_boosting(train, columns, **options)(test)


def out_of_memory(error: BaseException) -> bool:
    return isinstance(error, MemoryError) or "out of memory" in str(error).lower()


def batched_paths(factory: Callable[[str], Callable], contexts: list, steps: int, *, batch: int = 64, device: str = "cpu", to_cpu: bool = True):
    """(paths, mode): `steps` values for each context from a pretrained model; factory(device) gives a function of an array of
    equally long contexts and of the steps.  Contexts go in batches of one length, never padded.  Where memory runs
    out, the same on the CPU in half batches, then the last values; every other error is the caller's."""

    def run(where: str, size: int) -> np.ndarray:
        model, out = factory(where), np.empty((len(contexts), steps))
        lengths = np.array([len(c) for c in contexts])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            for k in range(0, len(at), size):
                part = at[k : k + size]
                made = np.asarray(model(np.stack([contexts[i] for i in part]), steps), float)
                if made.shape != (len(part), steps) or not np.isfinite(made).all():
                    raise ValueError("the model gave another shape, or values that aren't finite")
                out[part] = made
        return out

    tries = [(device, batch)] + ([("cpu", max(1, batch // 2))] if to_cpu and device != "cpu" else [])
    for where, size in tries:
        try:
            return run(where, size), where
        except (RuntimeError, MemoryError) as error:
            if not out_of_memory(error):
                raise
    return np.repeat(np.array([float(c[-1]) for c in contexts])[:, None], steps, axis=1), "fallback_last_value"


def foundation_arm(history: DataFrame, asked: DataFrame, horizon: int, factory: Callable[[str], Callable] | None = None, **options) -> DataFrame:
    """asked (entity, origin) with pred and mode: the value `horizon` months after the origin, the last of the horizon + 1 steps
    that foundation_paths asks for."""
    paths = foundation_paths(history, asked, horizon + 1, factory, **options)
    return paths.select(*[c for c in paths.columns if c not in ("path", "mode")], F.get("path", F.lit(horizon)).alias("pred"), "mode")


def foundation_paths(history: DataFrame, asked: DataFrame, steps: int, factory: Callable[[str], Callable] | None = None, *, context: int = 512, batch: int = 64, device: str = "cpu", entity: str = "mo", period: str = "period", value: str = "y") -> DataFrame:
    """asked (entity, origin) with path and mode: `steps` values from the origin on by a pretrained model that sees the last
    `context` values before the origin.  A context of under two values, or with a gap, gives its last value, none gives 0;
    without a model all do.  The factory is called in the workers, once in each and for each device.  Contexts are
    bounded, so each is one array."""
    mark = F.coalesce(F.col("__v"), F.lit(float("nan")))
    w = W.partitionBy(entity).orderBy("__p", "__ask")
    # A request comes before the value of its own month, so the number of values up to it is the place of the last one it sees.
    seen = history.select(entity, F.col(period).alias("__p"), F.col(value).alias("__v"), F.lit(1).alias("__ask")).unionByName(
        asked.select(entity, F.col("origin").alias("__p"), F.lit(None).cast("double").alias("__v"), F.lit(0).alias("__ask"))
    ).withColumn("__n", F.sum("__ask").over(w))
    block = lambda n: F.floor(n / context)
    known = seen.filter("__ask = 1").select(entity, block(F.col("__n")).alias("__b"), "__n", mark.alias("v"))
    # The last `context` values lie in two blocks of that many; only these are paired with the request.
    wanted = seen.filter("__ask = 0").select(entity, F.col("__p").alias("origin"), F.col("__n").alias("__last"))
    both = wanted.withColumn("__b", F.explode(F.array_distinct(F.array(block(F.col("__last")), block(F.greatest(F.col("__last") - context + 1, F.lit(0)))))))
    near = both.join(known, [entity, "__b"], "left").withColumn("__in", F.col("__n").between(F.col("__last") - context + 1, F.col("__last")))
    lists = near.groupBy(entity, "origin").agg(F.sort_array(F.collect_list(F.when(F.col("__in"), F.struct("__n", "v")))).alias("c"))
    ready = lists.select(F.col(entity).alias("e"), "origin", F.col("c.v").alias("c"))

    def run(batches):
        models: dict[str, Callable] = {}
        cached = lambda where: models[where] if where in models else models.setdefault(where, factory(where))
        for pdf in batches:
            contexts = [np.asarray(c, float) for c in pdf["c"]]
            whole = [i for i, c in enumerate(contexts) if factory is not None and len(c) > 1 and np.isfinite(c).all()]
            path = [[float(k[-1]) if len(k := c[np.isfinite(c)]) else 0.0] * steps for c in contexts]
            mode = ["fallback_last_value"] * len(contexts)
            if whole:
                paths, how = batched_paths(cached, [contexts[i] for i in whole], steps, batch=batch, device=device)
                for i, made in zip(whole, paths):
                    path[i], mode[i] = made.tolist(), how
            yield pd.DataFrame({"e": pdf["e"], "origin": pdf["origin"], "path": path, "mode": mode})

    return ready.mapInPandas(run, "e string, origin date, path array<double>, mode string").withColumnRenamed("e", entity)


#: How many of its last values an entity's state keeps: what the farthest feature, growth over a year, looks back on.
KEPT = 13


def state_of(seen: DataFrame) -> DataFrame:
    """(mo, recent, n, mean, m2): for each entity its last KEPT known values, the newest first, and the count, mean and summed
    squared deviation of all.  One row an entity, however long its history is."""
    rank = F.row_number().over(W.partitionBy("mo").orderBy(F.desc("period")))
    last = seen.withColumn("k", rank).filter(F.col("k") <= KEPT).groupBy("mo").agg(F.sort_array(F.collect_list(F.struct("k", "y"))).alias("r"))
    sums = seen.groupBy("mo").agg(F.count("y").alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count("y")).alias("m2"))
    return last.join(sums, "mo").select("mo", F.col("r.y").alias("recent"), "n", "mean", "m2")


def state_features(month, lag_months=(1, 2, 3, 12), windows=(3, 12)) -> dict:
    """The features of `windows.causal` and of the calendar for the month after a state, from the state's columns."""
    lag = lambda k: F.get("recent", k - 1)
    made = {f"y_lag_{k}": lag(k) for k in lag_months}
    made |= {"y_growth_mom": growth(lag(1), lag(2)), "y_growth_yoy": growth(lag(1), lag(13))}
    for n in windows:
        part, full = F.slice("recent", 1, n), F.size("recent") >= n
        mean = F.aggregate(part, F.lit(0.0), lambda a, x: a + x) / n
        spread = F.sqrt(F.aggregate(F.transform(part, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (n - 1))
        made |= {f"y_{name}_{n}": F.when(full, c) for name, c in (("mean", mean), ("std", spread), ("min", F.array_min(part)), ("max", F.array_max(part)))}
    made["spending_volatility"] = F.when(F.col("n") >= 2, ratio(F.sqrt(F.col("m2") / (F.col("n") - 1)), F.abs("mean")))
    return made | {"month": F.month(month), "quarter": F.quarter(month), "year": F.year(month)}


def moved_on() -> dict:
    """The state after the month's prediction has become its newest value."""
    step = F.col("pred") - F.col("mean")
    mean = F.col("mean") + step / (F.col("n") + 1)
    return {
        "recent": F.slice(F.concat(F.array("pred"), F.col("recent")), 1, KEPT), "n": F.col("n") + 1, "mean": mean,
        "m2": F.col("m2") + step * (F.col("pred") - mean), "path": F.concat("path", F.array("pred")),
    }


def recursive_model(history: DataFrame, origin: str, steps: int, predict, *, entities: DataFrame | None = None, frozen: DataFrame | None = None, lag_months=(1, 2, 3, 12), windows=(3, 12)) -> DataFrame:
    """(mo, period, lead_months, pred) of the months from `origin` on, with the lag, growth, rolling and volatility features
    made anew from each month's own predictions; only values before the origin are seen.  `predict` is a fitted model
    (boosting_model, or one loaded from disk) or a function of rows.  `frozen` holds columns by mo that stay as they were at the
    origin; an entity of `entities` without a past starts from the median of all.

    An entity is one row of bounded size, its state; a month is one transform of these rows, without a shuffle, and the
    states are written after each, so that neither the plan nor a lost executor's work grows with the steps."""
    transform = getattr(predict, "transform", predict)
    first = F.lit(origin).cast("date")
    seen = history.filter(F.col("period") < first).select("mo", "period", F.col("y").cast("double").alias("y")).filter("y is not null and not isnan(y)")
    if entities is not None:
        new = entities.select("mo").distinct().join(seen.select("mo").distinct(), "mo", "left_anti")
        seen = seen.unionByName(new.crossJoin(F.broadcast(order.median(seen, "y", "y"))).select("mo", F.add_months(first, -1).alias("period"), "y"))
        seen = seen.join(entities.select("mo").distinct(), "mo", "left_semi")
    states = state_of(seen).withColumn("path", F.array().cast("array<double>"))
    states = materialized(states if frozen is None else states.join(frozen, "mo", "left"), "recursive")
    kept = states.columns
    for k in range(steps):
        asked = states.withColumns(state_features(F.add_months(first, k), lag_months, windows))
        after = materialized(transform(asked).select(*kept, "pred").withColumns(moved_on()).select(kept), "recursive")
        forget(states)
        states = after
    path = states.select("mo", F.posexplode("path").alias("k", "pred"))
    return path.select("mo", F.add_months(first, F.col("k")).alias("period"), (F.col("k") + 1).alias("lead_months"), "pred")


def recursive_path(y: list, predict: Callable[[dict], float], steps: int, fallback: float | None = None) -> list[float]:
    """Month by month on its own predictions: lag and rolling features are made anew from the extended history."""
    past = [v for v in y if v is not None and np.isfinite(v)] or ([fallback] if fallback is not None else [0.0])
    out = []
    for _ in range(steps):
        lag = lambda k: past[-k] if len(past) >= k else None
        mean = lambda n: float(np.mean(past[-n:])) if len(past) >= n else None
        value = predict({"y_lag_1": lag(1), "y_lag_2": lag(2), "y_lag_3": lag(3), "y_lag_12": lag(12), "y_mean_3": mean(3), "y_mean_12": mean(12)})
        past.append(float(value))
        out.append(float(value))
    return out


def recursive_arm(history: DataFrame, origin: str, steps: int, predict: Callable[[dict], float], entity: str = "mo", period: str = "period", value: str = "y") -> DataFrame:
    """(entity, period, lead_months, pred) of the months after `origin`; nothing after it is seen.  An entity without
    values starts from the median of all values."""
    seen = history.filter(F.col(period) <= F.lit(origin).cast("date"))
    found = order.median(seen, value, "m").first()
    median = found["m"] if found else None

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        path = recursive_path(pdf["v"].tolist(), predict, steps, median)
        months = [(pd.Timestamp(origin) + pd.DateOffset(months=k + 1)).date() for k in range(steps)]
        return pd.DataFrame({"e": pdf["e"].iloc[0], "p": months, "lead_months": range(1, steps + 1), "pred": path})

    rows = seen.select(F.col(entity).alias("e"), F.col(period).alias("p"), F.col(value).alias("v"))
    out = rows.groupBy("e").applyInPandas(run, "e string, p date, lead_months int, pred double")
    return out.withColumnsRenamed({"e": entity, "p": period})


def cross_validate(panel: DataFrame, fit: Callable[[DataFrame, DataFrame], DataFrame], side_by_side: int = 3) -> DataFrame:
    """The test rows of every fold with pred, each from a model fitted on its fold's training rows (columns fold, role).

    Folds don't wait for one another: `side_by_side` of them submit their jobs at once.  A fold's error is the caller's."""
    folds = sorted(r[0] for r in panel.select("fold").distinct().collect())

    def one(k):
        rows = panel.filter(F.col("fold") == k)
        return fit(rows.filter("role = 'train'"), rows.filter("role = 'test'"))

    with ThreadPoolExecutor(max(1, side_by_side)) as pool:
        parts = list(pool.map(inheritable_thread_target(panel.sparkSession)(one), folds))
    out = parts[0] if parts else panel.limit(0).withColumn("pred", F.lit(None).cast("double"))
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def validate(panel: DataFrame, estimator, columns: list[str], *, target: str = "target", scale: bool = False, side_by_side: int = 3) -> DataFrame:
    """cross_validate of any Spark ML regressor: for each fold a new pipeline of medians of its training rows for what is
    missing (0 for a column without any value), standard scaling if asked for, and a copy of the estimator.

    The medians of all folds and columns come from one selection.  Fails where a prediction isn't finite."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    train = panel.filter("role = 'train'")
    medians = {r["fold"]: r for r in order.wide(order.quantiles_of(train, columns, [0.5], ["fold"]), columns, lambda c: [f"__{c}"], ["fold"]).collect()}

    def fit(rows: DataFrame, test: DataFrame) -> DataFrame:
        first = rows.select("fold").first()
        known = medians.get(first["fold"]) if first else None
        stages = [filled_in({c: known[f"__{c}"] if known else None for c in columns}), VectorAssembler(inputCols=[f"__{c}" for c in columns], outputCol="__v")]
        if scale:
            stages.append(StandardScaler(inputCol="__v", outputCol="__s", withMean=True, withStd=True))
        model = estimator.copy({estimator.getParam("featuresCol"): "__s" if scale else "__v", estimator.getParam("labelCol"): target, estimator.getParam("predictionCol"): "pred"})
        return Pipeline(stages=[*stages, model]).fit(rows.filter(F.col(target).isNotNull())).transform(test).select(*test.columns, "pred")

    out = materialized(cross_validate(panel, fit, side_by_side), "validated")
    return assert_none(out, F.col("pred").isNull() | F.isnan("pred") | (F.abs("pred") == float("inf")), "validation: a prediction isn't finite")


def fold_scores(panel: DataFrame, predictions: DataFrame, target: str = "target") -> DataFrame:
    """(fold, n_train, n_test, mae, r2) of each fold and of all rows (fold 'pooled', the sum of no training rows): one aggregate."""
    from monthgrid.operators.metrics import accuracy

    rows = predictions.select(F.col("fold").cast("string").alias("fold"), F.col(target).alias("target"), "pred")
    both = rows.unionByName(rows.withColumn("fold", F.lit("pooled")))
    sizes = panel.filter("role = 'train'").groupBy(F.col("fold").cast("string").alias("fold")).agg(F.count(F.lit(1)).alias("n_train"))
    return accuracy(both, ["fold"]).join(sizes, "fold", "left").select("fold", "n_train", F.col("n").alias("n_test"), "mae", "r2")
