"""Progress of runs as a stream of events.

The same transformation serves a batch table and a stream; on a stream the watermark
bounds the state, and events later than that are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LATE = "2 hours"


def hourly(events: DataFrame) -> DataFrame:
    """Events of each type in each hour."""
    marked = events.withWatermark("ts", LATE) if events.isStreaming else events
    return marked.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")


def latest(events: DataFrame) -> DataFrame:
    """The last state of each user, whatever order its events come in and however often."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "value"), "event_id").alias("s"), F.max("event_id").alias("event_id")).select("user_id", "event_id", "s.*")


def stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Event files of a folder as a stream, a file at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
