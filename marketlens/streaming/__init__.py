"""Streaming operators over the event stream: deduplication, view buckets, windows and idempotent micro-batches.

Each takes a streaming DataFrame, so it runs on files, sockets or logs alike; `drained` runs one to the end of what is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The files of a folder as they arrive, with the schema of those already there."""
    schema = spark.read.parquet(f"{folder}/{pattern}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(events: DataFrame, key: str = "event_id", late: str = "7 days") -> DataFrame:
    """One event for each key; state is dropped once the watermark has passed."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def view_buckets(events: DataFrame, late: str = "7 days") -> DataFrame:
    """Views count once for each user and half hour."""
    views = events.where("event_type = 'view'").withColumn("bucket", F.window("ts", "30 minutes")["start"])
    return views.select("user_id", "bucket").withWatermark("bucket", late).dropDuplicates(["user_id", "bucket"])


def hourly_counts(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Tumbling hours by kind (an extension: the original has no event-time windows)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def drained(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs the stream over all that is there, appends to a table at path, and reads it."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def idempotent(path: str):
    """A foreachBatch function: batch n replaces what an earlier try of batch n wrote, so retries leave no copies."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return put
