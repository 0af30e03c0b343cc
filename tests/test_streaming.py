"""Streams give the rows of their batch forms."""

from pyspark.sql import functions as F

from tests.oracle import SF_DIR
from tributary.operators import windows
from tributary.sources.readers import parquet
from tributary.streaming import anchored


def run(stream, tmp_path, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name).collect()


def test_anchored_stream_equals_batch(spark, tmp_path):
    e = parquet(spark, SF_DIR, "events").select("event_id", "event_type", "ts").orderBy("event_id")
    width = 6 * 3600
    for i in range(2):  # two files, one micro-batch each
        e.where(f"event_id {'<' if i == 0 else '>='} 500").coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    src = spark.readStream.schema("event_id long, event_type string, ts timestamp, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    t = F.unix_timestamp("ts")
    got = {(r.window_start, r.key): r["count"] for r in run(anchored.anchored_counts(src, t, F.col("event_type"), F.col("event_id"), width), tmp_path, "anchored")}
    batch = windows.anchored(e, t, width).groupBy("window_start", "event_type").count().collect()
    last = max(r.window_start for r in batch)  # still open in the stream
    assert got == {(r.window_start, r.event_type): r["count"] for r in batch if r.window_start < last} and got


def test_late_events_stay_and_old_ones_close_when_absolute(spark, tmp_path):
    rows = [(0, 100, "a"), (1, 90, "b"), (2, 20, "c"), (3, 200, "d"), (4, 300, "e")]
    spark.createDataFrame(rows, "seq long, t long, k string").coalesce(1).write.parquet(str(tmp_path / "in"))
    for absolute, starts in ((False, [100, 200]), (True, [20, 100, 200])):
        src = spark.readStream.schema("seq long, t long, k string").parquet(str(tmp_path / "in"))
        out = anchored.anchored_counts(src, F.col("t"), F.col("k"), F.col("seq"), 60, absolute)
        got = run(out, tmp_path / str(absolute), f"late_{absolute}")
        assert sorted({r.window_start for r in got}) == starts


def test_sliding_stream(spark, tmp_path):
    e = parquet(spark, SF_DIR, "events").withColumn("task", F.pmod("user_id", F.lit(4)).cast("int")).select("ts", "user_id", "task")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("ts timestamp, user_id long, task int").parquet(str(tmp_path / "in"))
    got = run(anchored.sliding_load(src, "ts", "user_id", "task", "1 day", "12 hours"), tmp_path, "sliding", "update")
    batch = windows.sliding_load(e, "ts", "user_id", "task", "1 day", "12 hours").collect()
    assert {(r.window_start, r.task, r.tuples, r.bytes) for r in got} == {(r.window_start, r.task, r.tuples, r.bytes) for r in batch}
