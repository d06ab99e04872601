"""Incremental collection: pages into an append-only table, and windowed counts of events that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.sources.replay import StoredPages
from lectern.sources.sinks import append_pages


def collect_pages(spark: SparkSession, path: str, table: str, checkpoint: str, pages_per_task: int = 10) -> StreamingQuery:
    """Take all stored pages into ``table``; a later call goes on behind the last page taken.

    Delivery is at least once, and a page already stored is recognised by its request, so every page is there once.
    """
    spark.dataSource.register(StoredPages)
    stream = spark.readStream.format("stored_pages").option("path", path).option("pages_per_task", pages_per_task).load()
    stamped = stream.withColumn("checksum", F.sha2("payload", 256))
    return stamped.writeStream.foreachBatch(lambda df, _: append_pages(df, table)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_events(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per window and type; events later than ``late`` behind the newest are dropped (streams only)."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("at", late)
    w = e.groupBy(F.window("at", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def deduplicated(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """First arrivals of each key, with a bounded memory of them in a stream."""
    if events.isStreaming:
        return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).dropDuplicatesWithinWatermark([key]).drop("at")
    return events.dropDuplicates([key])
