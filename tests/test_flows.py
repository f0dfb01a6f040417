from __future__ import annotations

import json

import numpy as np
import pytest
from pydantic import ValidationError
from pyspark.sql import functions as F

from monthgrid import config
from monthgrid.operators import blend, forecast, submit, subset
from monthgrid.plans import flows
from monthgrid.sources import files
from monthgrid.streaming.monthly import windowed_counts


def panel_of(spark, months, n=40, entities="abc"):
    rng = np.random.default_rng(15)
    rows = [(m, p, float(100.0 * (1 + k) + 3.0 * i + 8 * (i % 12) + rng.normal() + (150 if i > n - 4 else 0))) for k, m in enumerate(entities) for i, p in enumerate(months(2020, 1, n))]
    return spark.createDataFrame(rows, "mo string, period date, y double")


def drifting():
    """In the place of a pretrained model: the last step goes on."""
    return lambda device: lambda x, steps: x[:, -1:] + (x[:, -1:] - x[:, -2:-1]) * np.arange(1, steps + 1)


def test_flow_from_panel_to_event_scores(spark, months):
    target = panel_of(spark, months)
    features = flows.prepare(target).cache()
    oof = flows.out_of_fold(features, 1, trees=3, factory=drifting()).cache()
    assert oof.count() == 18 and {r.mode for r in oof.collect()} == {"cpu"}
    seen = oof.select("pred_trend", "pred_boost", "pred_foundation").collect()
    assert all(len(set(r)) == 3 and min(r) > 0 for r in seen)  # three arms, and none is another
    values = {(r.mo, r.period): r.y for r in target.collect()}
    back = lambda p, k: months(p.year, p.month, 1)[0] if k == 0 else months(p.year - (p.month - k < 1), (p.month - k - 1) % 12 + 1, 1)[0]
    for r in oof.collect():
        a, b = values[(r.mo, back(r.origin, 1))], values[(r.mo, back(r.origin, 2))]
        assert r.pred_foundation == pytest.approx(a + 2 * (a - b)) and r.target == values[(r.mo, r.period)]
    table = flows.score(oof).filter("fold = 'pooled'").collect()
    assert {r.model for r in table} == {"pred_trend", "pred_boost", "pred_foundation", "pred_blend"} and all(r.n == 18 for r in table)

    line = months(2020, 1, 40)
    news = spark.createDataFrame([(p, float(k % 3) if p != line[37] else 60.0, -0.5 if p == line[20] else 0.1) for k, p in enumerate(line)], "period date, news_shock_score double, sentiment_index double")
    found = flows.alerts(oof, news=news, history=target).cache()
    local, nation = found.filter("mo <> '__national__'"), found.filter("mo = '__national__'")
    assert local.count() == 18 and nation.count() == 40
    assert [r.period for r in nation.filter("news_alert").orderBy("period").collect()] == [line[20], line[37]]
    assert nation.filter("residual_shock").count() > 0 and nation.filter("residual_news_shock").count() > 0
    assert nation.filter("residual_news_shock and not residual_shock").count() == 0
    catalogue = spark.createDataFrame([(line[37],), (months(2030, 1, 1)[0],)], "event date")
    quality = {r.method: r for r in flows.event_quality(found, catalogue).collect()}
    assert set(quality) == set(flows.METHODS) and all((r.events, r.out_of_range) == (1, 1) for r in quality.values())
    assert quality["residual"].recall == 1.0 and quality["residual"].f1 > 0
    both, again = flows.reblend(oof, oof.drop("lead_months"), blend.CALIBRATED)
    assert both.filter("model = 'pred_boost' and verdict <> 'even'").count() == 0 and again.count() == 18


def test_gaps_start_a_series_anew(spark, months):
    line = months(2020, 1, 30)
    rows = [("a", p, 1, float(10 + k % 2), 10.0) for k, p in enumerate(line) if k not in (7, 8, 20)]
    oof = spark.createDataFrame(rows, "mo string, period date, lead_months int, target double, pred_boost double")
    got = {r.period: r for r in flows.alerts(oof).collect()}
    assert len(got) == 27 and {r.mo for r in got.values()} == {"a"}
    first = [k for k in range(30) if k not in (7, 8, 20) and not got[line[k]].cusum_eligible]
    assert first == [0, 1, 2, 3, 9, 10, 11, 12, 21, 22, 23, 24]


def test_training_targets_end_before_the_test(spark, months):
    features = flows.prepare(panel_of(spark, months, 46))
    config_ = config.EngineConfig(folds=config.FoldConfig(splits=2, fold_size=1, gap=1, min_train=24))
    oof = flows.out_of_fold(features, 6, config_, trees=2)
    # 22 origins at most come before the first test, and with min_train 24 no fold is left: the path is walked instead.
    assert {(r.fold, r.lead_months, r.origin) for r in oof.collect()} == {(0, 6, months(2023, 4, 1)[0])}
    assert oof.filter("pred_boost > 0 and target is not null").count() == 3
    empty = flows.out_of_fold(features, 12, config.EngineConfig(folds=config.FoldConfig(min_train=60)))
    assert empty.count() == 0 and "pred_trend" in empty.columns


def test_submission_from_three_arms(spark, months):
    target = panel_of(spark, months, 30)
    features = flows.prepare(target)
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("new",)], "mo string")
    arms = flows.ahead(features, "2022-07-01", 3, trees=2, factory=drifting(), entities=names).cache()
    assert arms.count() == 12 and arms.filter("pred_trend is null or pred_boost is null or pred_foundation is null").count() == 0
    wanted = spark.createDataFrame([(p,) for p in months(2022, 7, 3)], "period date")
    rows = flows.submission(arms, wanted, names).collect()
    assert [(r.mo, r.period) for r in rows] == [(m, p) for m in ("a", "b", "c", "new") for p in months(2022, 7, 3)] and all(r.pred > 0 for r in rows)
    first = {(r.mo, r.period): r for r in flows.blend.regime_blend(arms.withColumn("gate_alert", F.lit(False))).collect()}
    assert all(r.pred == first[(r.mo, r.period)].pred_blend for r in rows)


def test_foundation_adapter():
    asked = []

    def factory(device):
        def model(x, steps):
            asked.append((device, x.shape))
            if device == "gpu" and len(x) > 1:
                raise RuntimeError("out of memory")
            return np.repeat(x.mean(1)[:, None], steps, 1)
        return model

    contexts = [np.array([1.0, 3.0]), np.array([2.0, 2.0, 5.0]), np.array([5.0, 7.0])]
    paths, mode = forecast.batched_paths(factory, contexts, 3, batch=4, device="gpu")
    assert mode == "cpu" and paths.tolist() == [[2.0] * 3, [3.0] * 3, [6.0] * 3] and ("cpu", (2, 2)) in asked
    paths, mode = forecast.batched_paths(factory, contexts, 1, device="gpu", to_cpu=False)
    assert mode == "fallback_last_value" and paths.ravel().tolist() == [3.0, 5.0, 7.0]
    with pytest.raises(ZeroDivisionError):
        forecast.batched_paths(lambda d: lambda x, s: 1 / 0, contexts, 1)
    with pytest.raises(ValueError):
        forecast.batched_paths(lambda d: lambda x, s: np.full((len(x), s), np.nan), contexts, 1)


def test_foundation_arm_sees_the_past_only(spark, months):
    rows = [("a", p, float(k)) for k, p in enumerate(months(2020, 1, 6))] + [("b", months(2020, 1, 1)[0], 9.0)]
    line = months(2020, 1, 6)
    asked = spark.createDataFrame([("a", line[3]), ("a", line[5]), ("b", line[2]), ("c", line[2])], "mo string, origin date")
    add = lambda device: lambda x, steps: x[:, -1:] + np.arange(1, steps + 1)
    got = {(r.mo, r.origin): (r.pred, r.mode) for r in forecast.foundation_arm(spark.createDataFrame(rows, "mo string, period date, y double"), asked, 2, add, context=3).collect()}
    assert got[("a", line[3])] == (5.0, "cpu") and got[("a", line[5])] == (7.0, "cpu")
    assert got[("b", line[2])] == (9.0, "fallback_last_value") and got[("c", line[2])] == (0.0, "fallback_last_value")


def test_recursive_path_feeds_on_itself(spark, months):
    rows = [("a", p, 10.0 + k) for k, p in enumerate(months(2020, 1, 14))]
    predict = lambda df: df.withColumn("pred", F.col("y_lag_1") + F.col("step"))
    frozen = spark.createDataFrame([("a", 2.0), ("new", 0.5)], "mo string, step double")
    names = spark.createDataFrame([("a",), ("new",)], "mo string")
    out = forecast.recursive_model(spark.createDataFrame(rows, "mo string, period date, y double"), "2021-01-01", 3, predict, entities=names, frozen=frozen).collect()
    assert sorted((r.mo, r.lead_months, r.pred) for r in out) == [("a", 1, 23.0), ("a", 2, 25.0), ("a", 3, 27.0), ("new", 1, 16.0), ("new", 2, 16.5), ("new", 3, 17.0)]


def test_json_discovery_and_lookups(spark, tmp_path):
    root, data = tmp_path / "root", tmp_path / "root" / "datasets"
    data.mkdir(parents=True)
    for p in (data / "RBK.json", data / "mine.json", root / "other.json"):
        p.write_text("[]")
    found, looked = files.find_json(spark, ["mine.json", "datasets/mine.json", "gone.json"], [str(root), str(data)])
    assert [f.rsplit("/", 1)[-1] for f in found] == ["mine.json", "RBK.json"] and len(looked) == len(set(looked)) and any(x.endswith("gone.json") for x in looked)
    assert files.find_json(spark, [], [str(data)], auto=False) == ([], [])


def test_subset_of_entities(spark):
    rows = spark.createDataFrame([(f"e{k:02d}", float(k)) for k in range(1, 41)] + [("neg", -1.0)], "mo string, target double")
    got = subset.benchmark_subset(rows, 10, {"first": "E07"})
    assert got.count() == 10 and got.filter("mo = 'e07' and stratum is null").count() == 1
    assert sorted(r["count"] for r in got.filter("stratum is not null").groupBy("stratum").count().collect()) == [2, 2, 2, 3]
    with pytest.raises(ValueError):
        subset.anchors(rows, {"x": "e0"})
    with pytest.raises(ValueError):
        subset.draw(subset.strata(subset.levels(rows)), [99, 1, 1, 1])
    assert subset.even_sizes(10, 4) == [3, 3, 2, 2]


def test_config_is_strict(tmp_path):
    (tmp_path / "c.yaml").write_text("detect: {window: 12}\n")
    assert config.load(str(tmp_path / "c.yaml")).detect.window == 12
    (tmp_path / "d.json").write_text(json.dumps({"detect": {"windw": 12}}))
    with pytest.raises(ValidationError):
        config.load(str(tmp_path / "d.json"))
    with pytest.raises(ValidationError):
        config.EngineConfig().detect.window = 3


def test_weights_and_arm_choice(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"6": {"trend": 1, "boost": 3, "foundation": 0}}))
    w = blend.load_weights(str(tmp_path / "w.json"))
    assert w[6]["boost"] == 0.75 and sum(w[1].values()) == pytest.approx(1)
    (tmp_path / "w.json").write_text(json.dumps({"6": {"trend": 1}}))
    with pytest.raises(ValueError):
        blend.load_weights(str(tmp_path / "w.json"))
    df = spark.createDataFrame([("a", 1.0)], "mo string, pred_boost double")
    assert submit.select_arm(df, "pred_boost", 1).first().pred == 1.0
    for arm, n in (("pred_trend", 1), ("pred_boost", 2)):
        with pytest.raises(ValueError):
            submit.select_arm(df, arm, n)


def test_headers_of_sheets():
    rows = [["Report", None, None], ["region", "year", "year"], ["x", "2020", "1,5"]]
    assert files.header_row(rows) == 1 and files.unique_names(rows[1] + [None]) == ["region", "year", "year_2", "column_4"]
    assert files.header_row([]) == 0


def test_stream_counts(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", "a", 1.0), ("2024-01-01 02:00:00", "a", 2.0), ("2024-01-05 01:00:00", "a", 4.0)], "ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [(r.n, r.total) for r in spark.sql("select * from counts").collect()] == [(2, 3.0)]
