"""Frames of an event stream: tumbling windows of event time with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def daily_frames(events: DataFrame, *, late: str = "2 hours", width: str = "1 day") -> DataFrame:
    """(event_type, start, n, total, low, high) of each window; works on tables and streams."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    found = rows.groupBy("event_type", F.window("ts", width).alias("win")).agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.min("value").alias("low"), F.max("value").alias("high"))
    return found.select("event_type", F.col("win.start").alias("start"), "n", "total", "low", "high")


def write_frames(spark: SparkSession, source: str, schema, target: str, **options) -> None:
    """Run daily_frames over a folder of Parquet files that a stream fills, up to what is there, into Parquet frames.

    A frame is written once its watermark has passed; progress is kept beside the target, so a rerun goes on from there.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).parquet(source)
    run = daily_frames(stream, **options).writeStream.format("parquet").option("path", target).option("checkpointLocation", f"{target.rstrip('/')}.progress")
    run.outputMode("append").trigger(availableNow=True).start().awaitTermination()
