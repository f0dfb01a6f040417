"""The engine's flows: raw panel to features, features to out-of-fold predictions and metrics, predictions to alerts,
future months to a submission, and cached arms to a new blend.  Fits are written to the shared folder once they are made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from monthgrid.config import EngineConfig
from monthgrid.operators import blend, detect, evidence, folds, forecast, joins, metrics, submit, topology, windows
from monthgrid.operators.panel import direct, regularize
from monthgrid.session import materialized


def prepare(target: DataFrame, macro: DataFrame | None = None, news: DataFrame | None = None, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(mo, period, y) to the supervised matrix: regular calendar, causal windows, topology, macro and lagged news."""
    f = config.features
    rows = windows.features(regularize(target), lag_months=f.lags, windows=f.windows, warmup=f.warmup_months)
    rows = rows.join(topology.features(target), ["mo", "period"], "left")
    if macro is not None:
        rows = joins.attach(rows, macro, ["period"])
    if news is not None:
        rows = joins.attach(rows, news, ["period"], lag=f.news_lag)
        if "news_shock_score" in rows.columns:
            rows = rows.withColumn("local_news_shock", F.col("news_shock_score") * F.col("spending_volatility"))
    return rows


def numeric(features: DataFrame) -> list[str]:
    """What the trees see of a feature table: its numbers, without the value itself."""
    return [n for n, t in features.dtypes if t in ("double", "int", "bigint") and n != "y"]


def out_of_fold(features: DataFrame, horizon: int, config: EngineConfig = EngineConfig(), *, trees: int = 20, factory=None, columns: list[str] | None = None) -> DataFrame:
    """(mo, origin, period, lead_months, fold, target, pred_trend, pred_boost, pred_foundation, mode): the test rows of every
    purged fold at one horizon.  The trend is fitted for each fold and entity on the fold's training targets, the trees on the
    fold's training rows, and the pretrained model (`factory`; without one, last values, as `mode` says) sees the values before
    each origin.  Too short a history for a single fold is walked month by month instead (see `recursive_fold`)."""
    c = config.folds
    rows = direct(features, horizon)
    folds.check_panel(rows, ["mo", "origin"])
    columns = columns or numeric(features)
    splits = materialized(folds.fold_table(rows, c.splits, c.fold_size, max(c.gap, horizon), c.min_train, target_end="target_end"), "folds")
    if splits.isEmpty():
        return recursive_fold(features, horizon, config, trees=trees, factory=factory)
    split = materialized(folds.assign(rows, splits), "split")
    test = split.filter("role = 'test'")
    boost = forecast.cross_validate(split, lambda train, ahead: forecast.boosting_arm(train, ahead, columns, trees=trees).select("fold", "mo", "origin", F.col("pred").alias("pred_boost")))
    # An entity of a fold is a series of its own: one fit for each.
    own = F.concat_ws("\x1f", F.col("fold").cast("string"), "mo").alias("mo")
    known = split.filter("role = 'train'").select(own, F.col("target_end").alias("period"), F.col("target").alias("y"))
    trend = forecast.trend_arm(known, test.select(own, F.col("target_end").alias("period")), most_fallbacks=config.max_fallback_share)
    cut = F.split("mo", "\x1f", 2)
    trend = trend.select(cut[0].cast("int").alias("fold"), cut[1].alias("mo"), F.add_months("period", -horizon).alias("origin"), F.col("pred").alias("pred_trend"))
    pretrained = forecast.foundation_arm(features.select("mo", "period", "y"), test.select("mo", "origin").distinct(), horizon, factory)
    pretrained = pretrained.select("mo", "origin", F.col("pred").alias("pred_foundation"), "mode")
    out = test.select("mo", "origin", F.col("target_end").alias("period"), "lead_months", "fold", "target")
    return out.join(trend, ["fold", "mo", "origin"]).join(boost, ["fold", "mo", "origin"]).join(pretrained, ["mo", "origin"]).select(
        "mo", "origin", "period", "lead_months", "fold", "target", "pred_trend", "pred_boost", "pred_foundation", "mode"
    )


def ahead(features: DataFrame, origin: str, steps: int, config: EngineConfig = EngineConfig(), *, trees: int = 20, factory=None, entities: DataFrame | None = None) -> DataFrame:
    """(mo, origin, period, lead_months, pred_trend, pred_boost, pred_foundation, mode): the months from `origin` on by the three
    arms; only months before it are seen.  The trees are fitted one step ahead and walk on their own predictions; columns
    that don't come from the values themselves stay as last known for each entity."""
    past = features.filter(F.col("period") < F.lit(origin).cast("date"))
    made = forecast.state_features(F.col("period"), config.features.lags, config.features.windows)
    outside = [c for c in numeric(features) if c not in made]
    columns = [*made, *outside]
    train = past.withColumns({"month": F.month("period"), "quarter": F.quarter("period"), "year": F.year("period"), "target": F.col("y")})
    model = forecast.boosting_model(train, columns, trees=trees)
    last = past.groupBy("mo").agg(*[F.max_by(c, "period").alias(c) for c in outside]) if outside else None
    if last is not None and entities is not None:
        last = entities.select("mo").distinct().join(last, "mo", "left")
    boost = materialized(forecast.recursive_model(past.select("mo", "period", "y"), origin, steps, model, entities=entities, frozen=last, lag_months=config.features.lags, windows=config.features.windows), "ahead")
    months = boost.select("mo", "period")
    trend = forecast.trend_arm(past.select("mo", "period", "y"), months, most_fallbacks=1.0 if entities is not None else config.max_fallback_share)
    paths = forecast.foundation_paths(past.select("mo", "period", "y"), months.select("mo", F.lit(origin).cast("date").alias("origin")).distinct(), steps, factory)
    pretrained = paths.select("mo", "mode", F.posexplode("path").alias("k", "pred_foundation")).withColumn("lead_months", F.col("k") + 1).drop("k")
    return (
        boost.withColumnRenamed("pred", "pred_boost").join(trend.select("mo", "period", F.col("pred").alias("pred_trend")), ["mo", "period"])
        .join(pretrained, ["mo", "lead_months"])
        .select("mo", F.lit(origin).cast("date").alias("origin"), "period", "lead_months", "pred_trend", "pred_boost", "pred_foundation", "mode")
    )


def recursive_fold(features: DataFrame, horizon: int, config: EngineConfig = EngineConfig(), *, trees: int = 20, factory=None) -> DataFrame:
    """out_of_fold for a history too short for direct rows: the last origin whose target is known is the one fold, and the
    month `horizon` after it is reached by `ahead`.  Nothing where no origin has `min_train` months before it."""
    months = sorted(r[0] for r in features.select("period").distinct().collect())  # a calendar
    usable = [m for k, m in enumerate(months) if k >= config.folds.min_train and (months[-1].year - m.year) * 12 + months[-1].month - m.month >= horizon]
    schema = "mo string, origin date, period date, lead_months int, fold int, target double, pred_trend double, pred_boost double, pred_foundation double, mode string"
    if not usable:
        return features.sparkSession.createDataFrame([], schema)
    path = ahead(features, usable[-1].isoformat(), horizon + 1, config, trees=trees, factory=factory).filter(F.col("lead_months") == horizon + 1)
    known = features.filter("y is not null").select("mo", "period", F.col("y").alias("target"))
    rows = path.drop("lead_months").join(known, ["mo", "period"]).withColumns({"lead_months": F.lit(horizon), "fold": F.lit(0)})
    return rows.select([c.split()[0] for c in schema.split(", ")])


def score(oof: DataFrame, table: dict = blend.CALIBRATED) -> DataFrame:
    """Metrics by fold, pooled, horizon and arm, the blend among the arms."""
    rows = oof if "gate_alert" in oof.columns else oof.withColumn("gate_alert", F.lit(False))
    arms = ["pred_trend", "pred_boost", "pred_foundation", "pred_blend"]
    return metrics.pooled(metrics.long_form(blend.regime_blend(rows, table), arms, ["mo", "period", "fold", "lead_months"]), ["lead_months", "model"])


NATIONAL = "__national__"
METHODS = ("pelt", "binseg", "cusum", "residual", "residual_news", "tda", "consensus")


def national_series(history: DataFrame) -> DataFrame:
    """(mo, period, y, residual): the mean of all entities by month as one more series, against the mean of its three values before
    (fewer at its start, and the value itself at the first)."""
    rows = history.filter("y is not null").groupBy("period").agg(F.avg("y").alias("y"))
    before = W.orderBy("period").rowsBetween(-3, -1)  # over months only
    return rows.select(F.lit(NATIONAL).alias("mo"), "period", "y", (F.col("y") - F.coalesce(F.avg("y").over(before), F.col("y"))).alias("residual"))


def alerts(oof: DataFrame, config: EngineConfig = EngineConfig(), *, news: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """One-step predictions to the alerts of all detectors and their consensus, by entity and month.

    Months of an entity that don't follow one another are series of their own: no window or sum reaches over a gap.  `news`
    (period, news_shock_score and, if known, sentiment_index) makes news alerts, and residual alerts they support; `history`
    (mo, period, y) adds the national series, whose past isn't limited to the folds."""
    d = config.detect
    rows = oof.filter("lead_months = 1").select("mo", "period", F.col("target").alias("y"), (F.col("target") - F.col("pred_boost")).alias("residual"))
    if history is not None:
        rows = rows.unionByName(national_series(history))
    if news is not None:
        names = [c for c in ("news_shock_score", "sentiment_index") if c in news.columns]
        rows = joins.attach(rows, news.select("period", *names), ["period"])
    for c in ("news_shock_score", "sentiment_index"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("double"))
    run = windows.run_of("period", windows.by())
    rows = materialized(rows.withColumn("__mo", F.col("mo")).withColumn("mo", F.concat_ws("\x1f", "mo", run.cast("string"))), "series")
    rows = rows.withColumn("__z", windows.zscore("news_shock_score", d.window, windows.by(), d.history))
    rows = rows.withColumns({
        "news_alert": F.coalesce(F.col("__z") >= d.news_k, F.lit(False)) | F.coalesce(F.col("sentiment_index") <= d.negative_sentiment, F.lit(False)),
        "news_eligible": F.col("__z").isNotNull() | F.col("sentiment_index").isNotNull(),
    }).drop("__z")
    base = rows
    rows = detect.residual_barrier(rows, window=d.window, history=d.history, k=d.barrier_k, q=d.barrier_quantile)
    rows = detect.residual_news(rows, lookback=d.lookback)
    rows = rows.join(detect.cusum(base, history=d.history, drift=d.drift, threshold=d.threshold), ["mo", "period"], "left")
    for method in ("pelt", "binseg"):
        rows = rows.join(detect.segmentation(base, method, window=d.window, history=d.history, penalty=d.penalty, size=d.min_size), ["mo", "period"], "left")
    rows = rows.join(topology.features(base.select("mo", "period", "y")), ["mo", "period"], "left")
    rows = detect.distance_alert(rows, "tda_distance", window=d.window, history=d.history, q=d.tda_quantile)
    rows = detect.consensus(rows)
    able = F.lit(False)
    for m in ("cusum", "tda", "pelt"):
        able = able | F.coalesce(F.col(f"{m}_eligible"), F.lit(False))
    return rows.withColumn("consensus_eligible", able).withColumn("mo", F.col("__mo")).drop("__mo")


def macro_detections(found: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(method, detected): the months in which enough of the entities that a method could judge raise its alert, or the national
    series does; neighbouring months are paired (see detect.macro_events)."""
    local, out = found.filter(F.col("mo") != NATIONAL), None
    for m in METHODS:
        shares = detect.alert_share(local, f"{m}_shock", f"{m}_eligible")
        nation = found.filter(F.col("mo") == NATIONAL).groupBy("period").agg(F.max(F.coalesce(F.col(f"{m}_shock"), F.lit(False))).alias("national"))
        both = shares.join(nation, "period", "full")
        events = detect.macro_events(both, config.detect.macro_share, national="national").select(F.lit(m).alias("method"), F.col("event").alias("detected"))
        out = events if out is None else out.unionByName(events)
    return out


def event_quality(found: DataFrame, catalogue: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """detect.event_scores of all methods' macro events against a catalogue (event), over the months that were looked at."""
    return detect.event_scores(macro_detections(found, config), catalogue, config.event_tolerance_days, list(METHODS), observed=found)


def submission(arms: DataFrame, months: DataFrame, roster: DataFrame, table: dict = blend.CALIBRATED) -> DataFrame:
    """(mo, period, pred): the blend of the arms of `ahead` by lead, on the whole grid of roster and months, checked."""
    blended = blend.regime_blend(arms.withColumn("gate_alert", F.lit(False)), table).select("mo", "period", F.col("pred_blend").alias("pred"))
    return submit.assemble(roster, months, blended.join(F.broadcast(months.select("period").distinct()), "period", "left_semi"), fill=True)


def reblend(oof: DataFrame, test: DataFrame, table: dict, lead: int = 6) -> tuple[DataFrame, DataFrame]:
    """Cached arms under other weights: (metrics next to the factory's, the test blend at a fixed lead); nothing is fitted."""
    mine, factory = score(oof, table), score(oof, blend.FACTORY)
    keys = ["fold", "lead_months", "model"]
    both = evidence.verdicts(mine, factory, keys, 1e-6)
    ahead = test.withColumns({"lead_months": F.lit(lead), "gate_alert": F.lit(False)})
    return both, blend.regime_blend(ahead, table)
