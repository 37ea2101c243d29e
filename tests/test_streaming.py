"""Streams through the same pure functions as batches."""

from __future__ import annotations

import datetime as dt
import os

from bidweave.operators.bucketed import BucketedState
from bidweave.streaming import tasks
from bidweave.streaming.refresh import stream_upserts, windowed_counts


def test_micro_batches_merge_into_a_state(spark, tmp_path, rows_of):
    schema = "id int, title string, tag string"
    incoming = str(tmp_path / "in")
    state = BucketedState.create(spark.createDataFrame([(1, "a", "pursue")], schema), str(tmp_path / "state"), ["id"], 8)
    spark.createDataFrame([(1, "b", "wait"), (2, "c", "brief")], schema).coalesce(1).write.mode("append").parquet(incoming)
    for version in (1, 2):
        stream_upserts(spark.readStream.schema(schema).parquet(incoming), state, str(tmp_path / "cp"), ["tag"]).awaitTermination(60)
        if version == 1:
            assert rows_of(state.read(spark)) == [(1, "b", "pursue"), (2, "c", "brief")]
            spark.createDataFrame([(2, None, "wait"), (3, "d", None)], schema).coalesce(1).write.mode("append").parquet(incoming)
    assert rows_of(state.read(spark)) == [(1, "b", "pursue"), (2, "c", "brief"), (3, "d", None)]


def test_windows_of_a_stream_equal_those_of_a_batch(spark, tmp_path, rows_of):
    rows = [(dt.datetime(2024, 1, 1, h, 10), k) for h in range(6) for k in ("a", "b") for _ in range(h + 1)]
    path = str(tmp_path / "events")
    spark.createDataFrame(rows, "ts timestamp, k string").coalesce(1).write.parquet(path)
    stream = windowed_counts(spark.readStream.schema("ts timestamp, k string").parquet(path), "ts", "k", "2 hours")
    q = stream.writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows_of(spark.table("windows")) == rows_of(windowed_counts(spark.read.parquet(path), "ts", "k", "2 hours"))


def test_tasks_end_by_timer(spark, tmp_path, rows_of):
    """Files come one at a time: a result before its start, one in the last moment, one too late in event time, one behind the watermark."""
    at = lambda seconds: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)
    schema = "id long, at timestamp, started boolean, failed boolean, output string"
    start = lambda i, s: (i, at(s), True, False, None)
    result = lambda i, s, out="ok", failed=False: (i, at(s), False, failed, out)
    files = [
        [start(1, 0), start(2, 0), start(3, 1), start(4, 2), result(5, 20), start(6, 3), result(6, 30, "second")],
        [result(1, 60), result(2, 61, "late"), result(3, 9, None, True), result(3, 10, "again"), start(5, 15), result(6, 12, "first")],
        [start(7, 500), result(99, 480, "nobody's")],
        [result(4, 40, "behind the watermark"), result(7, 505)],
        [start(8, 9000)],
    ]
    for n, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{n}"))
        for f in (tmp_path / f"in/{n}").glob("*.parquet"):
            os.utime(f, (1_700_000_000 + n * 10, 1_700_000_000 + n * 10))
    spark.conf.set(tasks.STORE, tasks.PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = tasks.task_outcomes_stream(stream, "id", 60).writeStream.format("memory").queryName("outcomes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    finally:
        spark.conf.unset(tasks.STORE)
    assert rows_of(spark.table("outcomes")) == [(1, "done", "ok"), (2, "timed out", None), (3, "failed", None), (4, "timed out", None), (5, "done", "ok"), (6, "done", "first"), (7, "done", "ok")]
