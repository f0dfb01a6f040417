"""Sinks: Parquet with a manifest, byte-identical CSV copies, metric reports and fingerprinted caches."""

from __future__ import annotations

import datetime
import hashlib
import json
import math
import os
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from monthgrid.hadoop import Files


def write_with_manifest(df: DataFrame, path: str, sources: list[str], version: str = "1", partition_by: list[str] = ()) -> dict:
    """Parquet by Spark's committer, then its manifest beside it: rows and missing values by one aggregate of what was written."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    back = df.sparkSession.read.parquet(path)
    row = back.agg(F.count(F.lit(1)).alias("rows"), *[F.sum(F.col(c).isNull().cast("long")).alias(c) for c in back.columns]).first()
    manifest = {
        "schema_version": version, "processed_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "sources": sources,
        "rows": row["rows"], "missing_values": {c: row[c] or 0 for c in back.columns},
    }
    put_text(df.sparkSession, f"{path.rstrip('/')}.manifest.json", json.dumps(manifest, ensure_ascii=False, indent=1))
    return manifest


def put_text(spark, path: str, text: str) -> None:
    """A small file on any file system that Spark writes."""
    Files(spark).put(path, text)


def write_csv_copies(rows: DataFrame, paths: list[str], most: int = 1_000_000) -> str:
    """A small table (at most `most` rows) as identical CSV files with LF ends, each put in place by a rename; the MD5."""
    pdf = rows.limit(most + 1).toPandas()
    if len(pdf) > most:
        raise ValueError("a table this large goes out as Parquet")
    data = pdf.to_csv(index=False, lineterminator="\n").encode()
    for path in paths:
        with open(f"{path}.tmp", "wb") as f:
            f.write(data)
        os.replace(f"{path}.tmp", path)
    return hashlib.md5(data).hexdigest()


def metric_reports(metrics: DataFrame, stem: str) -> None:
    """A small metric table as CSV, JSON (no NaN) and Markdown."""
    rows = [r.asDict() for r in metrics.collect()]
    plain = lambda v: None if isinstance(v, float) and not math.isfinite(v) else v
    rows = [{k: plain(v) for k, v in r.items()} for r in rows]
    names = metrics.columns
    with open(f"{stem}.json", "w") as f:
        json.dump(rows, f, ensure_ascii=False, indent=1, default=str)
    with open(f"{stem}.csv", "w", newline="\n") as f:
        f.write(",".join(names) + "\n" + "".join(",".join("" if r[c] is None else str(r[c]) for c in names) + "\n" for r in rows))
    with open(f"{stem}.md", "w") as f:
        f.write("| " + " | ".join(names) + " |\n|" + " --- |" * len(names) + "\n" + "".join("| " + " | ".join("n/a" if r[c] is None else f"{r[c]:.4f}" if isinstance(r[c], float) else str(r[c]) for c in names) + " |\n" for r in rows))


def fingerprint(spark, config: dict, paths: list[str]) -> str:
    """A digest of a configuration and of the paths, sizes and times of the files at, under or matched by paths."""
    files = Files(spark)
    state = [s for p in sorted(paths) for s in files.state(p)]
    return hashlib.sha256(json.dumps([config, state], sort_keys=True, default=str).encode()).hexdigest()


def cached(spark, path: str, key: str, build) -> DataFrame:
    """The Parquet table under path that was built under the key, else built anew: written beside its place and put there by one
    rename, so that a table is whole or isn't there."""
    files, place = Files(spark), f"{path.rstrip('/')}/{key}"
    if not files.exists(f"{place}/_SUCCESS"):
        work = f"{path.rstrip('/')}/.work-{uuid.uuid4().hex}"
        build().write.parquet(work)
        if not files.rename(work, place):
            files.delete(work)  # another run was first
    return spark.read.parquet(place)
