"""Structured Streaming: event-time windows, sessions, and upserts into the vector log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.vectorlog import VectorLog

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def read_events(spark: SparkSession, folder: str, files: str = "events*.parquet") -> DataFrame:
    """A stream of the event files in a folder; ts becomes a timestamp, as watermarks need one."""
    raw = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(begin, event_type, n, total) per tumbling window; late events count until the watermark passes."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("begin"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, begin, finish, n) of each user's sessions, parted by gaps."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    return source.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "n")


def deduplicated(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Events once by their id, within the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(["event_id"])
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def streaks(events: DataFrame, least: int = 2) -> DataFrame:
    """(user_id, streak, tripped): a breaker per user that trips after `least` events in a row without a positive value.

    The state is one number a user, kept by the stream's state store.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak = state.get[0] if state.exists else 0
        tripped = streak >= least
        for pdf in batches:
            for v in pdf.sort_values(["ts", "event_id"])["value"]:
                streak = 0 if v > 0 else streak + 1
                tripped = tripped or streak >= least
        state.update((streak,))
        yield pd.DataFrame({"user_id": [key[0]], "streak": [streak], "tripped": [tripped]})

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id bigint, streak int, tripped boolean", "streak int", "update", GroupStateTimeout.NoTimeout)


def upsert_stream(vectors: DataFrame, log: VectorLog, checkpoint: str, base: int = 0):
    """Append every micro-batch of vectors(rid, vec, meta) to a log.

    A batch's seq is base and its number, so a batch that runs again writes the same seq and counts once. A new
    checkpoint on a log that has rows already takes base=log.next_seq(), and keeps that base when it is started again.
    """
    return vectors.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda df, epoch: log.upsert(df, base + epoch)).start()
