"""The command line over a small folder of tables, from observations to a submission."""

from __future__ import annotations

import json

import numpy as np
import pytest

from monthgrid.__main__ import main


def test_stages_from_the_command_line(spark, months, tmp_path, capsys):
    rng = np.random.default_rng(16)
    line = months(2020, 1, 36)
    rows = [(m, p, float(100 * (k + 1) + 2 * i + 9 * (i % 12) + rng.normal())) for k, m in enumerate("ab") for i, p in enumerate(line)]
    data, root, out = (str(tmp_path / n) for n in ("data", "root", "trial"))
    spark.createDataFrame(rows, "mo string, period date, y double").write.parquet(f"{data}/target.parquet")
    spark.createDataFrame([(line[30],)], "event date").write.parquet(f"{data}/events.parquet")
    (tmp_path / "c.json").write_text(json.dumps({"folds": {"horizons": [1], "splits": 2, "fold_size": 1}}))
    args = ["--data", data, "--root", root, "--config", str(tmp_path / "c.json"), "--trees", "2", "--months", "2"]
    assert main(["run", *args], spark) == 0
    record = json.loads(capsys.readouterr().out)
    assert [r["stage"] for r in record] == ["features", "oof_1", "metrics", "ahead", "submission", "alerts", "event_scores"] and all(r["built"] for r in record)
    assert main(["run", *args, "--stage", "submission"], spark) == 0
    assert [(r["stage"], r["built"]) for r in json.loads(capsys.readouterr().out)] == [("features", False), ("ahead", False), ("submission", False)]
    assert main(["list", *args], spark) == 0
    kept = {r["stage"]: r for r in json.loads(capsys.readouterr().out)}
    table = lambda n: spark.read.parquet(f"{root}/{n}/{kept[n]['key']}")
    assert all(r["kept"] for r in kept.values()) and table("submission").count() == 4 and table("event_scores").count() == 7
    assert table("submission").filter("pred > 0").count() == 4 and table("metrics").filter("fold = 'pooled'").count() == 4

    # Other weights rebuild what reads them only; a trial of them leaves all of it alone.
    (tmp_path / "w.json").write_text(json.dumps({"1": {"trend": 0, "boost": 1, "foundation": 0}}))
    assert main(["reblend", *args, "--weights", str(tmp_path / "w.json"), "--out", out], spark) == 0
    paths = json.loads(capsys.readouterr().out)
    mine = spark.read.parquet(paths["metrics"]).filter("fold = 'pooled'").toPandas().set_index("model")
    assert spark.read.parquet(paths["submission"]).count() == 4 and mine.loc["pred_blend"].candidate_mae == pytest.approx(mine.loc["pred_boost"].candidate_mae)
    with pytest.raises(ValueError):
        main(["reblend", *args, "--weights", str(tmp_path / "w.json"), "--out", f"{root}/x"], spark)
    assert main(["reblend", *args], spark) == 2
    assert main(["run", *args, "--weights", str(tmp_path / "w.json")], spark) == 0
    capsys.readouterr()
    assert main(["list", *args, "--weights", str(tmp_path / "w.json")], spark) == 0
    other = {r["stage"]: r for r in json.loads(capsys.readouterr().out)}
    assert {n for n in kept if kept[n]["key"] != other[n]["key"]} == {"metrics", "submission"}
    assert main(["sweep", *args], spark) == 0 and len(capsys.readouterr().out.split()) == 2
    with pytest.raises(FileNotFoundError):
        main(["run", "--data", str(tmp_path), "--root", root], spark)
    assert main(["unlock", *args], spark) == 0
