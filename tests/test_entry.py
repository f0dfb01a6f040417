"""Every registered query has its columns; a few run whole and agree with an independent engine."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from monthgrid.plans import registry

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def test_names_and_twins():
    assert set(registry.ORACLES) <= set(registry.QUERIES) and len(registry.QUERIES) > 90
    assert set(entry.oracle_sql()) <= set(entry.queries())


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", ["wn1_wn5_causal_features", "j5_asof_strict", "ag6_metrics_pooled", "ts2_cusum", "ts19_purged_rows", "sf15_three_way_dedup"])
def test_same_rows_as_the_twin(spark, name):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = registry.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    key = lambda row: tuple((v is None, str(v)) for v in row)
    ours = sorted((tuple(r[n] for n in names) for r in df.collect()), key=key)
    theirs = sorted(c.sql(f"select {', '.join(names)} from ({registry.ORACLES[name]})").fetchall(), key=key)
    assert [tuple(map(str, r)) for r in ours] == [tuple(map(str, r)) for r in theirs]
