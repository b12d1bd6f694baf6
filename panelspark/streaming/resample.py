"""Bars from a stream: an extension of batch resampling with the same buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(trades: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Right-closed bars of a stream with timestamp, symbol, price and volume.

    Stamps are moved back by a microsecond before windowing, so that one on an edge falls into the bucket
    it ends. In append mode a bar appears once the watermark has passed its end; rows later than ``late``
    are dropped.
    """
    at = F.col("timestamp").cast("timestamp")
    moved = trades.withColumn("_at", (at - F.expr("INTERVAL 0.000001 SECONDS"))).withWatermark("_at", late)
    g = moved.groupBy(F.window("_at", f"{seconds} seconds"), "symbol").agg(
        F.min_by("price", "timestamp").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "timestamp").alias("close"), F.sum("volume").alias("volume")
    )
    return g.select(F.col("window.end").cast("timestamp_ntz").alias("timestamp"), "symbol", "open", "high", "low", "close", "volume")
