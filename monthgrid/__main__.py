"""Command line: `python -m monthgrid run --data DIR --root DIR`.

run      build the stages that aren't kept under their keys yet (all, or those named and what they read)
list     the stages in their order, and whether each is kept
reblend  metrics and submission of kept predictions under other weights, in a folder of their own
sweep    delete what the present keys don't name
unlock   remove the lock of a run whose driver died
"""

from __future__ import annotations

import argparse
import json
import sys

from monthgrid import config as configuration
from monthgrid.operators import blend
from monthgrid.plans import flows
from monthgrid.plans.pipeline import stages_of
from monthgrid.plans.stages import Runner, protected
from monthgrid.session import build_session


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("monthgrid", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("command", choices=["run", "list", "reblend", "sweep", "unlock"])
    p.add_argument("--data", required=True, help="the folder of target.parquet and, if there are any, macro, news and events")
    p.add_argument("--root", required=True, help="the folder of the stages' tables")
    p.add_argument("--stage", action="append", help="a stage to build, with what it reads; may be given again")
    p.add_argument("--config", help="a YAML or JSON file of settings")
    p.add_argument("--weights", help="a JSON file of weights by horizon")
    p.add_argument("--out", help="reblend: where the new tables go")
    p.add_argument("--trees", type=int, default=20)
    p.add_argument("--months", type=int, default=12, help="how many months ahead")
    p.add_argument("--rebuild", action="store_true", help="build also what is kept")
    return p


def reblend(spark, runner: Runner, out: str, weights: dict) -> dict:
    """Kept arms under other weights: nothing is fitted, and what is kept must stay as it is."""
    out = out.rstrip("/")
    if out == runner.root or out.startswith(f"{runner.root}/") or runner.root.startswith(f"{out}/"):
        raise ValueError("a trial's tables go beside the root, not into it")
    names = [n for n in runner.order() if n.startswith("oof_") or n == "ahead"]
    keys = runner.keys(runner.order())
    if missing := [n for n in names if not runner.there(n, keys[n])]:
        raise ValueError(f"not kept yet: {', '.join(missing)}; run first")
    places = [runner.place(n, keys[n]) for n in runner.order() if runner.there(n, keys[n])]
    with protected(spark, places):
        read = lambda n: spark.read.parquet(runner.place(n, keys[n]))
        oof = None
        for n in names:
            if n != "ahead":
                oof = read(n) if oof is None else oof.unionByName(read(n))
        ahead = read("ahead")
        both, _ = flows.reblend(oof, ahead.drop("lead_months"), weights)
        both.write.mode("overwrite").parquet(f"{out}/metrics")
        months = ahead.select("period").distinct()
        flows.submission(ahead, months, ahead.select("mo").distinct(), weights).write.mode("overwrite").parquet(f"{out}/submission")
    return {"metrics": f"{out}/metrics", "submission": f"{out}/submission"}


def main(arguments: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(arguments)
    spark = spark or build_session()
    settings = configuration.load(a.config) if a.config else configuration.EngineConfig()
    weights = blend.load_weights(a.weights) if a.weights else blend.CALIBRATED
    graph = stages_of(spark, a.data, settings, weights=blend.CALIBRATED if a.command == "reblend" else weights, trees=a.trees, ahead_months=a.months)
    runner = Runner(spark, a.root, graph)
    if a.command == "run":
        runner.run(a.stage, rebuild=a.rebuild)
        print(runner.files.read(f"{runner.root}/run.json"))
    elif a.command == "list":
        keys = runner.keys(runner.order())
        print(json.dumps([{"stage": n, "key": k, "kept": runner.there(n, k), "reads": runner.stages[n].reads} for n, k in keys.items()], indent=1))
    elif a.command == "reblend":
        if not a.out or not a.weights:
            print("reblend needs --weights and --out", file=sys.stderr)
            return 2
        print(json.dumps(reblend(spark, runner, a.out, weights)))
    elif a.command == "sweep":
        print("\n".join(runner.sweep()))
    else:
        runner.unlock()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
