"""The stage runner and the stream of alarms: what is resumed, rebuilt and left alone."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from monthgrid.operators import detect
from monthgrid.plans.stages import LOCK, Runner, Stage, protected
from monthgrid.streaming.alarms import cusum_alarms, state_store


def line(calls, source, factor=2, broken=()):
    """raw -> twice -> sum, and a stage beside them."""

    def build(name, made):
        def run(spark, tables):
            calls.append(name)
            if name in broken:
                raise RuntimeError(f"{name} was killed")
            return made(spark, tables)

        return run

    return [
        Stage("raw", build("raw", lambda spark, t: spark.read.parquet(source)), sources=(source,)),
        Stage("twice", build("twice", lambda spark, t: t["raw"].withColumn("x", F.col("id") * factor)), reads=("raw",), parameters={"factor": factor}),
        Stage("sum", build("sum", lambda spark, t: t["twice"].agg(F.sum("x").alias("s"))), reads=("twice",)),
        Stage("beside", build("beside", lambda spark, t: t["raw"].limit(1)), reads=("raw",)),
    ]


def test_a_killed_run_goes_on_where_it_was(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(10).write.parquet(source)
    with pytest.raises(RuntimeError, match="sum was killed"):
        Runner(spark, root, line(calls, source, broken=("sum",))).run()
    assert calls == ["raw", "twice", "sum"] and not os.path.exists(f"{root}/{LOCK}")
    calls.clear()
    tables = Runner(spark, root, line(calls, source)).run()
    assert calls == ["sum", "beside"] and tables["sum"].first().s == 90
    assert [(r["stage"], r["built"]) for r in json.load(open(f"{root}/run.json"))] == [("raw", False), ("twice", False), ("sum", True), ("beside", True)]
    calls.clear()
    assert Runner(spark, root, line(calls, source)).run(["sum"])["sum"].first().s == 90 and calls == []


def test_a_write_that_was_cut_off_is_not_a_table(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(10).write.parquet(source)
    runner = Runner(spark, root, line(calls, source))
    runner.run()
    place = runner.place("sum", runner.keys(runner.order())["sum"])
    os.remove(f"{place}/_SUCCESS")
    os.makedirs(f"{root}/sum/.work-of-a-dead-driver")
    calls.clear()
    assert runner.run()["sum"].first().s == 90 and calls == ["sum"]
    assert runner.sweep() == ["sum/.work-of-a-dead-driver"]


def test_changes_reach_what_reads_them_and_nothing_else(spark, tmp_path):
    source, root, calls = str(tmp_path / "in"), str(tmp_path / "out"), []
    spark.range(10).write.parquet(source)
    Runner(spark, root, line(calls, source)).run()
    calls.clear()
    assert Runner(spark, root, line(calls, source, factor=3)).run()["sum"].first().s == 135 and calls == ["twice", "sum"]
    calls.clear()
    assert Runner(spark, root, line(calls, source)).run()["sum"].first().s == 90 and calls == []  # the old tables are kept
    spark.range(10, 11).write.mode("append").parquet(source)
    assert Runner(spark, root, line(calls, source)).run()["sum"].first().s == 110 and calls == ["raw", "twice", "sum", "beside"]
    os.makedirs(f"{root}/other")
    gone = Runner(spark, root, line(calls, source)).sweep()
    assert len(gone) == 6 and os.path.exists(f"{root}/other") and len(os.listdir(f"{root}/sum")) == 1
    assert len(Runner(spark, root, line(calls, source)).sweep(everything=True)) == 4 and os.path.exists(f"{source}/_SUCCESS")


def test_one_run_at_a_time_and_sound_graphs(spark, tmp_path):
    root, runner = str(tmp_path), Runner(spark, str(tmp_path), [])
    with runner.locked():
        with pytest.raises(RuntimeError, match="another run"):
            Runner(spark, root, []).run()
    assert runner.run() == {}
    none = lambda spark, t: None
    for stages in ([Stage("a", none), Stage("a", none)], [Stage("a", none, reads=("b",))], [Stage("../a", none)], [Stage(".a", none)]):
        with pytest.raises(ValueError):
            Runner(spark, root, stages)
    with pytest.raises(ValueError, match="a -> b -> a"):
        Runner(spark, root, [Stage("a", none, reads=("b",)), Stage("b", none, reads=("a",))]).order()
    with pytest.raises(ValueError, match="no stage"):
        Runner(spark, root, [Stage("a", none)]).order(["x"])


def test_a_stage_leaves_its_table_only(spark, tmp_path):
    from monthgrid.session import materialized, shared_dir

    def build(spark, t):
        return materialized(spark.range(5), "stage-work").filter("id > 1")

    there = lambda: [n for n in os.listdir(shared_dir(spark)) if n.startswith("stage-work")]
    assert Runner(spark, str(tmp_path), [Stage("a", build)]).run()["a"].count() == 3 and there() == []
    assert build(spark, {}).count() == 3 and len(there()) == 1  # outside of a runner the caller decides


def test_protected_outputs(spark, tmp_path):
    (tmp_path / "submission.csv").write_text("a")
    paths = [str(tmp_path / "submission.csv"), str(tmp_path / "none")]
    with protected(spark, paths):
        pass
    with pytest.raises(RuntimeError, match="submission"), protected(spark, paths):
        (tmp_path / "submission.csv").write_text("longer")


def test_stream_and_batch_give_the_same_alarms(spark, months, tmp_path):
    rng = np.random.default_rng(14)
    line_ = months(2020, 1, 30)
    rows = [(m, p, float(rng.normal(0, 1) + (3 if m == "a" and k > 15 else 0))) for m in ("a", "b", "c") for k, p in enumerate(line_)]
    rows = [r for r in rows if not (r[0] == "c" and r[1] > line_[2])] + [("b", months(2023, 1, 1)[0], None)]
    schema = "mo string, period date, y double"
    state_store(spark)
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))

    def go():
        made = cusum_alarms(spark.readStream.schema(schema).parquet(source))
        q = made.writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
        q.awaitTermination(120)
        assert q.exception() is None

    # Three runs of the query: each takes up the state of the one before.
    for a, b in ((0, 3), (3, 17), (17, 40)):
        spark.createDataFrame([r for r in rows if r[1] in line_[a:b] or (b == 40 and r[1] not in line_)], schema).repartition(2).write.mode("append").parquet(source)
        go()
    spark.createDataFrame([("a", line_[4], 1e9)], schema).write.mode("append").parquet(source)
    go()
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(out)
    assert [(r.mo, r.period, r.cusum_score) for r in got.filter("late").collect()] == [("a", line_[4], None)]
    names = ["mo", "period", "cusum_score", "cusum_shock", "cusum_eligible"]
    batch = detect.cusum(spark.createDataFrame(rows, schema)).select(names).collect()
    key = lambda r: (r.mo, r.period)
    for ours, theirs in zip(sorted(got.filter("not late").select(names).collect(), key=key), sorted(batch, key=key), strict=True):
        assert ours[:2] == theirs[:2] and ours[3:] == theirs[3:] and (ours[2] == theirs[2] or ours[2] == pytest.approx(theirs[2]))
    assert got.filter("cusum_shock").count() > 0
