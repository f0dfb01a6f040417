"""The panel engine's stages: from tables of observations to features, out-of-fold predictions, metrics, alerts, scores of
events and a submission."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.config import EngineConfig
from monthgrid.hadoop import Files
from monthgrid.operators import blend
from monthgrid.operators.panel import calendar
from monthgrid.plans import flows
from monthgrid.plans.stages import Stage


def stages_of(spark, data: str, config: EngineConfig = EngineConfig(), *, weights: dict = blend.CALIBRATED, trees: int = 20, factory=None, ahead_months: int = 12) -> list[Stage]:
    """The graph over the Parquet tables of a folder: target (mo, period, y); where they are there, macro (period and its columns),
    news (period, news_shock_score, sentiment_index) and events (event).  What a stage depends on is among its parameters,
    so that a changed setting rebuilds the stages that it touches and what reads them."""
    data = data.rstrip("/")
    files = Files(spark)
    place = {n: f"{data}/{n}.parquet" for n in ("target", "macro", "news", "events")}
    there = {n: p for n, p in place.items() if files.exists(p)}
    if "target" not in there:
        raise FileNotFoundError(place["target"])
    read = lambda s, n: s.read.parquet(there[n]) if n in there else None
    plain = lambda part: json.loads(part.model_dump_json())
    model = f"{factory.__module__}.{factory.__qualname__}" if factory else None
    fitted = {"folds": plain(config.folds), "most_fallbacks": config.max_fallback_share, "trees": trees, "model": model}

    def union(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def future(spark, t):
        origin = t["features"].agg(F.max("period")).first()[0]
        after = f"{origin.year + origin.month // 12}-{origin.month % 12 + 1:02d}-01"
        return flows.ahead(t["features"], after, ahead_months, config, trees=trees, factory=factory, entities=read(spark, "target").select("mo").distinct())

    def submitted(spark, t):
        ends = t["ahead"].select(F.lit(1).alias("mo"), "period")
        return flows.submission(t["ahead"], calendar(ends).select("period"), t["ahead"].select("mo").distinct(), weights)

    sources = lambda *names: tuple(there[n] for n in names if n in there)
    horizons = [f"oof_{h}" for h in config.folds.horizons]
    named = {str(h): w for h, w in weights.items()}
    out = [Stage("features", lambda s, t: flows.prepare(read(s, "target"), read(s, "macro"), read(s, "news"), config), sources=sources("target", "macro", "news"), parameters=plain(config.features))]
    out += [
        Stage(f"oof_{h}", lambda s, t, h=h: flows.out_of_fold(t["features"], h, config, trees=trees, factory=factory), reads=("features",), parameters=fitted | {"horizon": h})
        for h in config.folds.horizons
    ]
    out += [
        Stage("metrics", lambda s, t: flows.score(union([t[h] for h in horizons]), weights), reads=tuple(horizons), parameters={"weights": named}),
        Stage("ahead", future, reads=("features",), sources=sources("target"), parameters=fitted | {"months": ahead_months}),
        Stage("submission", submitted, reads=("ahead",), parameters={"weights": named}),
    ]
    if "oof_1" in horizons:
        found = lambda s, t: flows.alerts(t["oof_1"], config, news=read(s, "news"), history=read(s, "target"))
        out.append(Stage("alerts", found, reads=("oof_1",), sources=sources("target", "news"), parameters=plain(config.detect)))
        if "events" in there:
            scores = lambda s, t: flows.event_quality(t["alerts"], read(s, "events"), config)
            out.append(Stage("event_scores", scores, reads=("alerts",), sources=sources("events"), parameters={"share": config.detect.macro_share, "tolerance": config.event_tolerance_days}))
    return out
