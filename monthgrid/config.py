"""Configuration as frozen models; unknown keys are errors.  The defaults are the engine's published settings."""

from __future__ import annotations

import json

from pydantic import BaseModel, ConfigDict, Field


class Frozen(BaseModel):
    model_config = ConfigDict(frozen=True, extra="forbid")


class FeatureConfig(Frozen):
    lags: tuple[int, ...] = (1, 2, 3, 12)
    windows: tuple[int, ...] = (3, 12)
    warmup_months: int = Field(12, ge=0)
    news_lag: int = Field(1, ge=0)


class FoldConfig(Frozen):
    horizons: tuple[int, ...] = (1, 3, 6, 12)
    splits: int = Field(3, ge=1)
    fold_size: int = Field(2, ge=1)
    gap: int = Field(1, ge=0)
    min_train: int = Field(6, ge=1)


class DetectConfig(Frozen):
    window: int = Field(24, ge=4)
    history: int = Field(4, ge=2)
    penalty: float = 2.5
    min_size: int = 2
    threshold: float = Field(2.0, gt=0)
    drift: float = Field(0.5, ge=0)
    barrier_k: float = 1.8
    barrier_quantile: float = Field(0.9, gt=0, lt=1)
    tda_quantile: float = Field(0.85, gt=0, lt=1)
    macro_share: float = Field(0.085, gt=0, le=1)
    lookback: int = Field(2, ge=0)
    news_k: float = Field(2.0, gt=0)
    negative_sentiment: float = Field(-0.3, ge=-1, le=1)


class EngineConfig(Frozen):
    features: FeatureConfig = FeatureConfig()
    folds: FoldConfig = FoldConfig()
    detect: DetectConfig = DetectConfig()
    event_tolerance_days: int = 31
    max_fallback_share: float = Field(0.05, ge=0, le=1)


def load(path: str) -> EngineConfig:
    """From a YAML or JSON file."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return EngineConfig.model_validate(json.loads(text))
    import yaml

    return EngineConfig.model_validate(yaml.safe_load(text) or {})
