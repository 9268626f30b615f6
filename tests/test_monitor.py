"""Polls of batches as files of a stream."""

from datetime import datetime, timedelta

from tabulon.streaming.frozen_store import state_kept
from tabulon.streaming.monitor import outcomes

SCHEMA = "batch_id string, polled_at timestamp, state string, output string"


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


def run(spark, folder, n):
    """Reads what is new under folder, a file at a time, and returns all outcomes so far."""
    with state_kept(spark):
        polls = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", n).parquet(f"{folder}/in")
        outcomes(polls, timedelta(hours=1), "5 minutes").writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/cp").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(tuple(r) for r in spark.read.parquet(f"{folder}/out").collect())


def test_batches_end_once(spark, tmp_path):
    def put(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    put([("a", at(0), "validating", None), ("b", at(1), "in_progress", None), ("c", at(2), "in_progress", None), (None, at(2), "failed", None), ("d", None, "failed", None)])
    assert run(spark, tmp_path, 1) == []
    put([("a", at(9), "completed", "file-a"), ("a", at(7), "in_progress", None), ("b", at(8), "completed", None), ("d", at(4), "failed", "x")])
    want = [("a", "completed", at(9), "file-a"), ("b", "completed_without_output", at(8), None), ("d", "failed", at(4), None)]
    assert run(spark, tmp_path, 1) == want
    # after a restart ends aren't told again, nor are late and repeated states
    put([("a", at(9), "completed", "file-a"), ("a", at(10), "failed", None), ("b", at(11), "completed", "late"), ("e", at(20), "cancelled", None), ("e", at(19), "expired", None)])
    want = sorted([*want, ("e", "expired", at(19), None)])
    assert run(spark, tmp_path, 1) == want
    # c's deadline passes only when the watermark does
    put([("f", at(64), "in_progress", None)])
    assert run(spark, tmp_path, 1) == want
    put([("f", at(90), "in_progress", None)])
    want = sorted([*want, ("c", "timed_out", at(62), None)])
    assert run(spark, tmp_path, 1) == want
    put([("c", at(91), "completed", "too late"), ("f", at(91), "completed", "in time")])
    assert run(spark, tmp_path, 1) == sorted([*want, ("f", "completed", at(91), "in time")])
