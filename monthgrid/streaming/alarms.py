"""CUSUM alarms over a stream of monthly values: an extension, since the batch detector is prefix-invariant.

A value's score depends on nothing after it, so it can be given as it arrives: an entity's state is its first `history`
values, until their mean and spread are known, then these, the two sums and the last month.  That is one small row an
entity, whatever the length of its series, and it outlives a restart in the query's checkpoint.

Values of an entity must arrive in the order of their months, over batches; within a batch they are put in order.  A value that
comes after a later one was scored is given back with `late`, without a score, and leaves the state alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "mo string, period date, y double, cusum_score double, cusum_shock boolean, cusum_eligible boolean, late boolean"
STATE = "first array<double>, mid double, scale double, high double, low double, last date"


class Cusum(StatefulProcessor):
    def __init__(self, history: int = 4, drift: float = 0.5, threshold: float = 2.0):
        self.history, self.drift, self.threshold = history, drift, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("cusum", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first, mid, scale, high, low, last = self.state.get() if self.state.exists() else ([], None, None, 0.0, 0.0, None)
        first, out = list(first or []), []
        for period, y in pd.concat(list(rows)).sort_values("period", kind="stable")[["period", "y"]].itertuples(index=False):
            if y is None or np.isnan(y):
                continue
            if last is not None and period <= last:
                out.append((key[0], period, y, None, False, False, True))
                continue
            last = period
            if len(first) < self.history:
                first.append(float(y))
                if len(first) == self.history:
                    mid, scale = float(np.mean(first)), max(float(np.std(first, ddof=1)), 1e-8)
                out.append((key[0], period, y, None, False, False, False))
                continue
            z = (y - mid) / scale
            high, low = max(0.0, high + z - self.drift), max(0.0, low - z - self.drift)
            score = max(high, low) / self.threshold
            out.append((key[0], period, y, score, score >= 1, True, False))
            if score >= 1:
                high = low = 0.0
        self.state.update((first, mid, scale, high, low, last))
        yield pd.DataFrame(out, columns=["mo", "period", "y", "cusum_score", "cusum_shock", "cusum_eligible", "late"])

    def close(self) -> None:
        pass


def cusum_alarms(values: DataFrame, *, history: int = 4, drift: float = 0.5, threshold: float = 2.0) -> DataFrame:
    """(mo, period, y, cusum_score, cusum_shock, cusum_eligible, late) for a stream of (mo, period, y).  The session needs a state
    store that keeps composite state: `state_store(spark)`."""
    rows = values.select(F.col("mo").cast("string").alias("mo"), F.col("period").cast("date").alias("period"), F.col("y").cast("double").alias("y"))
    return rows.groupBy("mo").transformWithStateInPandas(Cusum(history, drift, threshold), OUT, outputMode="Append", timeMode="None")


def state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
