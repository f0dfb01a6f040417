"""Session defaults and contract assertions shared by every operator."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from monthgrid.hadoop import Files


def build_session(app: str = "monthgrid", master: str | None = None) -> SparkSession:
    """A session with the settings the operators are planned for: UTC, ANSI, AQE."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master or "SPARK_MASTER" not in os.environ:
        builder = builder.master(master or "local[8]").config("spark.sql.shuffle.partitions", "8")
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def assert_unique(df: DataFrame, keys: list[str], what: str = "rows") -> DataFrame:
    """Fail when a key occurs twice: the join-cardinality contract of a build side."""
    twice = df.groupBy(*keys).count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{what}: duplicate key {twice[0].asDict()}")
    return df


def assert_none(df: DataFrame, condition, message: str) -> DataFrame:
    """Fail when any row meets `condition`."""
    if df.filter(condition).limit(1).count():
        raise ValueError(message)
    return df


def dealt(df: DataFrame, key: str) -> DataFrame:
    """df by key over as many tasks as the session plans for.  For what computes much on few bytes (fits, segmentations): left
    to itself, the adaptive plan would put small tables into one task."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), key)


def finite(column):
    """The value where it is a finite number, NULL otherwise (NaN and infinities included)."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder, read back: a cut lineage that outlives a lost executor."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _kept:
        made.append(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


#: The lists of paths of the `working_tables` that are open.
_kept: list[list[str]] = []


@contextmanager
def working_tables(spark: SparkSession):
    """Delete, at its end, every table that `materialized` made inside: for a caller that has written its result, or failed."""
    made: list[str] = []
    _kept.append(made)
    try:
        yield
    finally:
        _kept.remove(made)
        files = Files(spark)
        for path in made:
            files.delete(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables that `materialized` made and that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            Files(df.sparkSession).delete(path)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.  Where it is unset, a folder of this machine
    serves local masters; a cluster without the setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found:
        if not current.isDefined() and not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = current.get() if current.isDefined() else f"{tempfile.gettempdir()}/checkpoints/monthgrid"
    if not current.isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found
