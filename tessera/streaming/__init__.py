"""Streaming forms of the event operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_stats(events: DataFrame, *, ts: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``start, <key>, n, mean, std`` over tumbling windows; rows later than ``late`` are dropped by a stream. The same plan serves batches."""
    rows = events.withColumn("__ts", F.col(ts).cast("timestamp"))
    rows = rows.withWatermark("__ts", late) if events.isStreaming else rows
    one = rows.groupBy(F.window("__ts", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("std"))
    return one.select(F.col("w.start").alias("start"), key, "n", "mean", "std")
