"""Micro-batches over the pure write functions of ``operators.merge``, and windowed counts of event streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bidweave.operators.bucketed import BucketedState


def stream_upserts(changes: DataFrame, state: BucketedState, checkpoint: str, keep: list[str] | None = None, prepare: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Merges each micro-batch into a bucketed state: it rewrites the buckets of its keys only, in place.

    Of rows of one key in a batch the last one counts if ``prepare`` leaves one of each, as it must. A batch that is tried again changes nothing more."""

    def apply(batch: DataFrame, number: int) -> None:
        # The batch is read more than once, to find its buckets and to merge them.
        rows = (prepare(batch) if prepare else batch).persist()
        try:
            state.upsert(rows, keep or ())
        finally:
            rows.unpersist()

    return changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts per window and key; for streams, rows later than ``late`` are dropped by the watermark."""
    source = events.withWatermark(ts, late) if events.isStreaming else events
    return source.groupBy(F.window(ts, size, slide) if slide else F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
