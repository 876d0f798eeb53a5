"""Running class counts over a stream of records, in event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_classes(events: DataFrame, time: str, label: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """window_start, class, count; windows close once the watermark has passed them."""
    marked = events.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    counts = marked.groupBy(F.window("_at", window), F.coalesce(F.col(label).cast("string"), F.lit("<NA>")).alias("class")).agg(F.count(F.lit(1)).alias("count"))
    return counts.select(F.col("window.start").alias("window_start"), "class", "count")
