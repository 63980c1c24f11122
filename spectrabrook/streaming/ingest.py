"""Streaming ingest of events into an hourly series table. Fits on it stay batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def hourly_stream(events: DataFrame, late: str = "2 hours", time: str = "ts", value: str = "value") -> DataFrame:
    """Counts and sums by hour of a stream; an hour is final once the watermark has passed it."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", late).groupBy(F.window("_at", "1 hour").alias("w")).agg(F.count(F.lit(1)).cast("double").alias("y"), F.sum(value).alias("x1")).select(F.col("w.start").alias("hour"), "y", "x1")


def append_series(hours: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append final hours to a Parquet table, each once; runs over what is there and stops."""
    return hours.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
