"""An extension: event counts per window from a stream, late events dropped by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, at: str = "ts", kind: str = "event_type", width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and kind; state is dropped once the watermark has passed a window."""
    w = F.window(at, width)
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(w.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
