"""Streams of the event file against the same rows in a batch."""

import pytest
from pyspark.sql import functions as F

from lumidoc.sources.vectorlog import VectorLog
from lumidoc.streaming import events as E

SF = "/root/testdata/sf0.001"


def batch(spark):
    return spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df, name, mode, folder):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{folder}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_windows(spark, tmp_path):
    stream = E.windowed(E.read_events(spark, SF), "1 day")
    got = {(r.begin, r.event_type): r.n for r in drained(stream, "w", "complete", tmp_path).collect()}
    assert got == {(r.begin, r.event_type): r.n for r in E.windowed(batch(spark), "1 day").collect()}


def test_deduplicated(spark, tmp_path):
    assert drained(E.deduplicated(E.read_events(spark, SF), "100 days"), "d", "append", tmp_path).count() == batch(spark).select("event_id").distinct().count()


def test_streaks(spark, tmp_path):
    stream = E.read_events(spark, SF).withColumn("value", F.when(F.col("event_id") % 3 > 0, F.lit(0.0)).otherwise(F.lit(1.0)))
    got = {r.user_id: r.streak for r in drained(E.streaks(stream), "s", "update", tmp_path).collect()}
    want = {}
    for r in batch(spark).orderBy("ts", "event_id").collect():
        want[r.user_id] = 0 if r.event_id % 3 == 0 else want.get(r.user_id, 0) + 1
    assert got == want


def test_upserts(spark, tmp_path):
    log = VectorLog(spark, f"file://{tmp_path}/log", "events", 2, "h1")
    vectors = E.read_events(spark, SF).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rid"), F.array(F.col("value").cast("float"), F.lit(1.0).cast("float")).alias("vec"), F.lit(None).cast("string").alias("meta"))
    E.upsert_stream(vectors, log, f"{tmp_path}/checkpoint").awaitTermination(120)
    assert log.live().count() == batch(spark).select("user_id").distinct().count()


@pytest.mark.parametrize("gap", ["30 minutes", "6 hours"])
def test_sessions_hold_every_event_once(spark, gap):
    s = E.sessions(batch(spark), gap)
    assert s.agg(F.sum("n")).first()[0] == batch(spark).count()
