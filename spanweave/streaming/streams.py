"""Structured Streaming counterparts: file arrival, event windows and conversation turns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their value per type and tumbling window; works on a batch and, with a watermark, on a stream."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    w = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    return w.select(F.col("w.start").alias("window_start"), "event_type", "n", F.round("v", 4).alias("total_value"))


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Events per user and session."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    s = e.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"), "n")


def file_arrival(spark: SparkSession, folder: str, graph_id: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Parses Python files as they arrive and hands each batch of entities to `sink` (an upsert)."""
    from spanweave.sources.files import decoded
    from spanweave.sources.parsing import extract_entities

    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.[pP][yY]").option("recursiveFileLookup", True).load(folder)

    def each(batch: DataFrame, epoch: int) -> None:
        files = decoded(batch.select("path", "content")).select(F.lit(graph_id).alias("graph_id"), "path", "content")
        sink(extract_entities(files), epoch)

    return raw.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def conversation_turns(spark: SparkSession, folder: str, checkpoint: str, out: str) -> StreamingQuery:
    """Appends conversation turns arriving as JSON lines to a table."""
    s = spark.readStream.schema("conversation_id string, user string, assistant string, timestamp string").json(folder)
    return s.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
