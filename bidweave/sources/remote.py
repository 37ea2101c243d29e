"""Work that is done elsewhere: uploads, robots and models. Their results arrive as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.text import strip_fences
from bidweave.sources.csv_import import UPLOAD_LIMIT

#: Seconds that are waited for a robot's and for an agent's task.
ROBOT_WAIT, AGENT_WAIT = 60, 120


def upload_status(size: Column) -> Column:
    """What becomes of an upload of so many bytes; null is no file at all."""
    return F.when(size.isNull(), "no file").when(size > UPLOAD_LIMIT, "too large").otherwise("accepted")


def task_results(tasks: DataFrame, results: DataFrame, key: str, wait: int) -> DataFrame:
    """Every task with its output if that came within ``wait`` seconds of the start.

    ``tasks`` has the key and started_at, ``results`` the key, finished_at, failed and output; status is done, failed or timed out.
    Of several results of a task the first counts."""
    first = results.groupBy(key).agg(F.min("finished_at").alias("finished_at"), F.min_by("failed", "finished_at").alias("failed"), F.min_by("output", "finished_at").alias("output"))
    joined = tasks.join(first, key, "left")
    in_time = F.coalesce(F.unix_micros("finished_at") - F.unix_micros("started_at") <= wait * 1_000_000, F.lit(False))
    status = F.when(~in_time, "timed out").when(F.col("failed"), "failed").otherwise("done")
    return joined.select(key, status.alias("status"), F.when(status == "done", F.col("output")).alias("output"))


def model_reply(reply: Column, schema: str) -> Column:
    """A model's JSON answer, with or without a fence around it; null for anything else."""
    return F.from_json(strip_fences(reply), schema)
