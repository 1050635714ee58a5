"""Streaming twins replayed over files must equal the batch operators."""

import random
import time

from pyspark.sql import functions as F

from spanforge.operators import series as S
from spanforge.streaming.online import online_windows
from spanforge.streaming.watchdog import latest_status, stale_status, watch


def drain(df, name, mode="append", folder=None):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def signals(spark, seconds=240):
    rnd = random.Random(11)
    rows = []
    for v in ("a", "b", "c"):
        x = 2.0
        for t in range(seconds):
            x = max(0.0, x + rnd.uniform(-1.2, 1.2))
            rows.append((v, t, x if v != "c" or t < seconds - 20 else 4.0))
    return spark.createDataFrame(rows, "vid string, t int, motion double")


def test_online_windows_equal_batch(spark, tmp_path):
    """In-order batches: all windows, also those open at the end, once the watermark has passed."""
    df = signals(spark)
    clock = spark.createDataFrame([("z", t, 0.0) for t in (900, 1200, 1500)], df.schema)
    for i in range(4):
        df.filter((F.col("t") >= i * 60) & (F.col("t") < i * 60 + 60)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for t in (900, 1200, 1500):
        clock.filter(F.col("t") == t).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(online_windows(stream, 3.0, 1.2, 3, 12, late="60 seconds"), "online", folder=tmp_path / "ck")
    got = sorted((r.vid, r.start_s, r.end_s, r.source) for r in spark.table("online").collect())
    want = sorted(map(tuple, S.hysteresis(df, "motion", 3.0, 1.2, 3, 12).collect()))
    assert got == want and len(want) > 5 and "motion_eof" in {w[3] for w in want}


def test_online_windows_count_late_rows(spark, tmp_path):
    first = [("a", t, 5.0) for t in range(20)]
    second = [("a", 5, 5.0), ("a", 19, 5.0), ("a", 20, 0.0), ("a", 20, 0.0)]
    for rows in (first, second):
        spark.createDataFrame(rows, "vid string, t int, motion double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vid string, t int, motion double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    drain(online_windows(stream, 3.0, 1.2, 3, 60, late="1 hour"), "late", folder=tmp_path / "ck")
    rows = spark.table("late").collect()
    assert [(r.vid, r.n_rows) for r in rows if r.source == "late"] == [("a", 3)]
    assert [(r.start_s, r.end_s) for r in rows if r.source == "motion"] == [(0, 20)]


def test_watchdog_batch_rule(spark):
    rows = [("a", "2024-01-01 10:00:00", "Processing (10%)"), ("b", "2024-01-01 10:05:00", "Processing (50%)"), ("b", "2024-01-01 10:20:00", "Done"), ("c", "2024-01-01 11:30:00", "Processing (1%)")]
    df = spark.createDataFrame(rows, "vid string, u string, status string").select("vid", F.to_timestamp("u").alias("updated"), "status")
    out = {r.vid: (r.stalled, r.status) for r in stale_status(latest_status(df), F.to_timestamp(F.lit("2024-01-01 12:00:00"))).collect()}
    assert out == {"a": (True, "Failed: stalled (no update for 120 min)"), "b": (False, "Done"), "c": (False, "Processing (1%)")}


def test_watchdog_reports_a_silent_stream(spark, tmp_path):
    """One file, then nothing: the running job reads as stalled, the finished one and late old rows do not."""
    df = spark.createDataFrame([("a", "Processing (10%)", 0), ("b", "Processing (50%)", -60), ("b", "Complete", 0)], "vid string, status string, ago int")
    now = F.current_timestamp() + F.make_dt_interval(secs=F.col("ago"))
    df.select("vid", now.alias("updated"), "status").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("vid string, updated timestamp, status string").parquet(str(tmp_path / "in"))
    q = watch(stream, minutes=0.1).writeStream.outputMode("append").format("memory").queryName("watch").option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and q.exception() is None and not spark.table("watch").filter("stalled").count():
            time.sleep(1)
        time.sleep(3)
        assert q.exception() is None
    finally:
        q.stop()
    rows = spark.table("watch").collect()
    assert [(r.vid, r.status) for r in rows if r.stalled] == [("a", "Failed: stalled (no update for 0 min)")]
    assert ("b", "Complete") in {(r.vid, r.status) for r in rows}
