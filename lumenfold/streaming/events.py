"""Streaming forms of first-seen deduplication and windowed counts; batch results are the check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_events(spark: SparkSession, folder: str) -> DataFrame:
    """A file stream of event tables; NTZ times are read as UTC instants."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def first_seen(events: DataFrame, key: list[str], delay: str = "1 hour") -> DataFrame:
    """State is dropped once the watermark passes it."""
    return events.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


def windowed(events: DataFrame, size: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    x = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type")
    return x.agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All there is, then stop; a restart goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
