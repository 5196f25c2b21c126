"""Streams with state: repeated events dropped within the watermark, and the last progress of each run.

An event may come late and more than once. What is kept of a run is one small row, its
latest event (its time as microseconds, which no time zone moves), so the state grows
with the runs and not with their events; a run that has been silent for IDLE_MS of
event time is told as ended and forgotten.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.stored import store

LATE = "2 hours"
IDLE_MS = 24 * 3600 * 1000
PROGRESS = "user_id long, event_id long, at long, event_type string, value double, events long, ended boolean"
STATE = "event_id long, at long, event_type string, value double, events long"


def once(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events, each once; on a stream within the watermark, which bounds what is remembered."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def _advance(idle_ms: int):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last = state.get
            state.remove()
            yield pd.DataFrame([(key[0], *last, True)], columns=[c.split()[0] for c in PROGRESS.split(", ")])
            return
        best, seen, newest = (tuple(state.get[:4]), state.get[4], state.get[1]) if state.exists else (None, 0, None)
        for frame in frames:
            seen += len(frame)
            top = frame.loc[frame["event_id"].idxmax()]
            if best is None or top["event_id"] > best[0]:
                best = (int(top["event_id"]), int(top["at"]), top["event_type"], None if pd.isna(top["value"]) else float(top["value"]))
            newest = max(int(frame["at"].max()), newest or 0)
        state.update((*best, seen))
        state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs() + 1) + idle_ms)
        yield pd.DataFrame([(key[0], *best, seen, False)], columns=[c.split()[0] for c in PROGRESS.split(", ")])

    return step


def progress(events: DataFrame, idle_ms: int = IDLE_MS) -> DataFrame:
    """The progress of each user's run after each batch: its latest event, how many there were, and whether it has ended."""
    ts = F.col("ts").cast("timestamp")
    known = events.filter("user_id is not null and event_id is not null and ts is not null").select("user_id", "event_id", ts.alias("ts"), F.unix_micros(ts).alias("at"), "event_type", "value")
    return once(known).groupBy("user_id").applyInPandasWithState(_advance(idle_ms), PROGRESS, STATE, "update", GroupStateTimeout.EventTimeTimeout)


def read_to_end(events: DataFrame, name: str, idle_ms: int = IDLE_MS) -> DataFrame:
    """Run a stream of events to its end and return the last progress of each user."""
    spark: SparkSession = events.sparkSession
    empty = store(spark.createDataFrame([], PROGRESS + ", batch long"), name)  # also names a fresh folder
    folder = empty._stored_at

    def keep(batch: DataFrame, number: int) -> None:
        # by number, so that a batch that is tried again replaces itself
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{folder}-out/batch={number}-done")

    run = progress(events, idle_ms).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    run.awaitTermination()
    told = spark.read.schema(PROGRESS + ", batch long").option("recursiveFileLookup", "true").parquet(f"{folder}-out")
    # a run may go on after it was told as ended, so its events are summed over its parts
    last = told.groupBy("user_id").agg(F.max_by(F.struct("event_id", "at", "event_type", "value"), "event_id").alias("s"))
    parts = told.groupBy("user_id").agg(F.sum(F.when(F.col("ended"), F.col("events")).otherwise(0)).alias("past"), F.max_by(F.struct("events", "ended"), F.struct("batch", ~F.col("ended"))).alias("l"))
    total = F.col("past") + F.when(F.col("l.ended"), 0).otherwise(F.col("l.events"))
    return last.join(parts, "user_id").select("user_id", "s.event_id", F.timestamp_micros("s.at").alias("ts"), "s.event_type", "s.value", total.alias("events"))


def from_folder(spark: SparkSession, folder: str, schema, files: int = 1) -> DataFrame:
    """Event files as a stream, `files` at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(folder)
