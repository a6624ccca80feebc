"""The running averages over a stream of log events: the same means, with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_averages(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(key, start, value, n): mean of (ts, key, value) by key and tumbling window; works on batch and streaming frames."""
    log = log.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    out = rows.groupBy("key", F.window("ts", width).alias("w")).agg(F.avg("value").alias("value"), F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), "value", "n")
