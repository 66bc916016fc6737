"""Tumbling-window alert counts, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def alert_counts(events: DataFrame, threshold: float, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(window_start, client_id, n, n_alerts): rows and rows above the threshold per client and window.

    On a stream the watermark bounds the state: a window is final once events are ``lateness`` past its end.
    """
    rows = events.where("value IS NOT NULL").withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("ts", lateness)
    client = F.concat(F.lit("c"), F.col("user_id") % 9)
    counts = rows.groupBy(F.window("ts", width), client.alias("client_id")).agg(F.count("*").alias("n"), F.count_if(F.col("value") > threshold).alias("n_alerts"))
    return counts.select(F.col("window.start").alias("window_start"), "client_id", "n", "n_alerts")
