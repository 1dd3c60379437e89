"""Streams: incremental ingest of new files, and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def ingest_parquet(spark: SparkSession, folder: str, schema: T.StructType, target: str, checkpoint: str, transform=None) -> StreamingQuery:
    """Load each new file of a folder exactly once and stop when all are loaded; the checkpoint remembers them."""
    rows = spark.readStream.schema(schema).parquet(folder)
    rows = transform(rows) if transform else rows
    return (
        rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def windowed_counts(events: DataFrame, time: str, keys: tuple[str, ...], window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events per window and key; rows later than ``late`` behind the newest are left out, so state stays bounded."""
    at = F.window(F.col(time).cast("timestamp"), window)
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.groupBy(at.alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("window_start"), *keys, "events")


def deduplicated(events: DataFrame, time: str, keys: tuple[str, ...], late: str = "30 minutes") -> DataFrame:
    """First of equal events within the watermark."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return timed.dropDuplicatesWithinWatermark(list(keys))
