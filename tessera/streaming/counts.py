"""Streaming forms of the counting workloads: the same plans over unbounded input, with watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.operators.workloads import word_count


def stream_table(spark: SparkSession, folder: str, name: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that match ``folder/name.parquet`` or arrive in that folder."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{folder}/{name}.parquet*")


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(start, event_type, n, total) for tumbling windows; rows later than ``late`` are dropped when streaming."""
    # watermarks need a point in time; times without a zone are taken in that of the session
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def running_words(lines: DataFrame) -> DataFrame:
    """(word, n) so far, for complete or update mode."""
    return word_count(lines, "value")


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    """Runs what has arrived into an in-memory table of the driver; for small results and tests."""
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
