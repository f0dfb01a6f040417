"""A stage runner: tables built from tables, each kept under the fingerprint of what it was built from.

A stage's key is a digest of its name, its version, its parameters, the keys of the stages it reads, and the paths, sizes
and times of the source files it reads.  Its table is written to a hidden folder beside its place and then renamed to
<root>/<stage>/<key>: on a file system with atomic renames (local disks, HDFS) a table is whole or isn't there, so a driver that
dies loses the stage at hand, and the next run goes on with it.  (On an object store a rename is a copy; there the
table's _SUCCESS file, which Spark writes last, is what counts as well.)  A changed parameter or file changes the keys of
its stage and of all that read it, and of nothing else.  One runner at a time works under a root: the first to create the
lock holds it.
"""

from __future__ import annotations

import hashlib
import json
import time
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from monthgrid.hadoop import Files
from monthgrid.session import working_tables

LOCK = ".runner.lock"


@dataclass(frozen=True)
class Stage:
    """build(spark, tables): the stage's DataFrame from those it reads, by name."""

    name: str
    build: Callable[..., DataFrame]
    reads: tuple[str, ...] = ()
    sources: tuple[str, ...] = ()
    parameters: dict = field(default_factory=dict)
    version: str = "1"


class Runner:
    def __init__(self, spark, root: str, stages: list[Stage]):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)
        self.stages = {s.name: s for s in stages}
        if len(self.stages) < len(stages):
            raise ValueError("two stages have one name")
        if bad := [n for n in self.stages if not n or n.startswith((".", "_")) or "/" in n]:
            raise ValueError(f"not a stage's name: {bad[0]!r}")
        for s in stages:
            if unknown := [r for r in s.reads if r not in self.stages]:
                raise ValueError(f"{s.name} reads {unknown[0]}, which is no stage")

    def order(self, wanted: list[str] | None = None) -> list[str]:
        """The wanted stages (all, if none are named) and what they read, each after what it reads."""
        out, open_ = [], []

        def visit(name: str):
            if name in out:
                return
            if name in open_:
                raise ValueError(f"stages read one another: {' -> '.join([*open_, name])}")
            open_.append(name)
            for r in self.stages[name].reads:
                visit(r)
            open_.pop()
            out.append(name)

        for name in wanted or self.stages:
            if name not in self.stages:
                raise ValueError(f"no stage {name}; there are {', '.join(self.stages)}")
            visit(name)
        return out

    def keys(self, names: list[str]) -> dict[str, str]:
        """The key of each stage, in the order of `order`."""
        keys: dict[str, str] = {}
        for name in names:
            s = self.stages[name]
            state = [name, s.version, s.parameters, {r: keys[r] for r in s.reads}, {p: self.files.state(p) for p in s.sources}]
            keys[name] = hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()[:32]
        return keys

    def place(self, name: str, key: str) -> str:
        return f"{self.root}/{name}/{key}"

    def there(self, name: str, key: str) -> bool:
        return self.files.exists(f"{self.place(name, key)}/_SUCCESS")

    @contextmanager
    def locked(self):
        """Hold the root's lock, or fail with the note of who holds it.  A lock left by a dead driver is removed by `unlock`."""
        note = json.dumps({"application": self.spark.sparkContext.applicationId, "since": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())})
        if not self.files.put(f"{self.root}/{LOCK}", note, replace=False):
            raise RuntimeError(f"another run works under {self.root}: {self.files.read(f'{self.root}/{LOCK}')}")
        try:
            yield
        finally:
            self.unlock()

    def unlock(self) -> None:
        self.files.delete(f"{self.root}/{LOCK}")

    def run(self, wanted: list[str] | None = None, *, rebuild: bool = False) -> dict[str, DataFrame]:
        """The tables of the wanted stages and of what they read; only what isn't kept under its key is built.  A record of each stage's
        key, seconds and whether it was built goes to <root>/run.json after every stage."""
        with self.locked():
            names = self.order(wanted)
            keys, tables, record = self.keys(names), {}, []
            for name in names:
                began, place = time.perf_counter(), self.place(name, keys[name])
                built = rebuild or not self.there(name, keys[name])
                if built:
                    work = f"{self.root}/{name}/.work-{uuid.uuid4().hex}"
                    s = self.stages[name]
                    with working_tables(self.spark):  # all that a stage leaves is its table
                        s.build(self.spark, {r: tables[r] for r in s.reads}).write.parquet(work)
                    self.files.delete(place)  # what a rename that failed on the way, or an earlier build, left
                    if not self.files.rename(work, place):
                        raise RuntimeError(f"{name}: {place} could not be put in its place")
                tables[name] = self.spark.read.parquet(place)
                record.append({"stage": name, "key": keys[name], "built": built, "seconds": round(time.perf_counter() - began, 3)})
                self.files.put(f"{self.root}/run.json", json.dumps(record, indent=1))
            return tables

    def sweep(self, *, everything: bool = False) -> list[str]:
        """Delete what the stages' present keys don't name (all of it with `everything`): only under the folders of this
        runner's stages, never another folder of the root."""
        gone = []
        with self.locked():
            keys = {} if everything else self.keys(self.order())
            for name in self.stages:
                for child in self.files.children(f"{self.root}/{name}"):
                    if child != keys.get(name):
                        self.files.delete(f"{self.root}/{name}/{child}")
                        gone.append(f"{name}/{child}")
        return gone


def snapshot(spark, paths: list[str]) -> dict[str, list]:
    """The state of files that a run must leave alone (see `unchanged`)."""
    files = Files(spark)
    return {p: files.state(p) for p in paths}


@contextmanager
def protected(spark, paths: list[str]):
    """Fail if anything at these paths was changed, added or removed meanwhile: a trial under other weights must not touch
    the outputs in use."""
    before = snapshot(spark, paths)
    yield
    changed = [p for p, state in snapshot(spark, paths).items() if state != before[p]]
    if changed:
        raise RuntimeError(f"a protected output was changed: {', '.join(changed)}")
