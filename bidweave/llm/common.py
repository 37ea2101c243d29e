"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Characters of text that one vectorised step works on; bounds the memory of a Python worker.
STEP_CHARS = 1 << 20


PACKAGE = Path(__file__).resolve().parents[1]


#: Rows that Spark hands to a Python worker at once. Rows are whole texts, so its default of 10,000 would take hundreds of MB.
BATCH_ROWS = 500


def prepare(spark: SparkSession) -> None:
    """Makes a session fit for the operators that run Python: small Arrow batches, unless the
    session asks for yet smaller ones, and this package on the executors, unless their path has it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    context = spark.sparkContext
    roots = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if str(PACKAGE.parent) in roots or getattr(context, "_bidweave_shipped", False):
        return
    # On the driver only, which serves it to the executors until it ends.
    folder = tempfile.mkdtemp()
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / f"{PACKAGE.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for path in sorted(PACKAGE.rglob("*.py")):
            z.write(path, path.relative_to(PACKAGE.parent))
    context.addPyFile(str(target))
    context._bidweave_shipped = True


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder. Only Spark opens the path, so any store that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def steps(texts: list[str], budget: int = STEP_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about ``budget`` characters; a longer text has a range of its own."""
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > budget:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches (views, nothing is copied), so that few texts are Python objects at a time.

    What earlier batches took is given back to the system: workers live longer than tasks."""
    size = 0
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        size += batch.nbytes
        if size > 16 << 20:
            size = 0
            give_back()
    give_back()


def give_back() -> None:
    """Returns freed memory of Arrow's pool and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str | None:
    """The folder for checkpoints that driver and executors share; None where the cluster names none."""
    return spark.conf.get("spark.checkpoint.dir", None)


def _checkpoint_root(spark: SparkSession) -> str:
    folder = shared_dir(spark)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = spark.sparkContext._jvm.System.getProperty("java.io.tmpdir") + "/bidweave-checkpoints"
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder, so that lost executors cost no recomputation.

    Where the session names no folder (local tests), one under java.io.tmpdir is set. The files stay until the
    session's cleaner (spark.cleaner.referenceTracking.cleanCheckpoints) or ``checkpoints_in`` removes them."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(_checkpoint_root(df.sparkSession))
    return df.checkpoint(eager=True)


def new_folder(spark: SparkSession, root: str | None = None) -> str:
    """A folder of its own for the tables of one run."""
    return root or f"{_checkpoint_root(spark)}/run-{uuid.uuid4().hex}"


class Scratch:
    """Tables of one run, in a folder of the shared ones that is removed when the session's JVM ends."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self._made = spark, new_folder(spark), 0
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        files.mkdirs(where)
        files.deleteOnExit(where)

    def keep(self, df: DataFrame) -> DataFrame:
        """``df`` written as a table of its own, and read again: its lineage ends there."""
        self._made += 1
        path = f"{self.folder}/{self._made}.parquet"
        df.write.parquet(path)
        return self.spark.read.parquet(path)


def numbered(rows: DataFrame, group: str, order: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the order of their group: a table with ``_pid`` and ``_at``, and what turns these into places.

    All rows are dealt out by range, so that a group may fill many tasks; the second frame has (_pid, group, _first, _before, _n)
    for each stretch of a group in one task, so the place, from 0, is _at - _first + _before. Null groups are one group. Equal rows may take any order."""
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie").drop("_tie")
    table = scratch.keep(dealt.select("*", F.spark_partition_id().alias("_pid"), F.monotonically_increasing_id().alias("_at")))
    stretches = table.groupBy("_pid", group).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    return table, stretches.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0).cast("bigint")))


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@contextlib.contextmanager
def checkpoints_in(spark: SparkSession, folder: str) -> Iterator[None]:
    """Checkpoints made inside go to the folder and are removed at the end; no frame made inside may be used afterwards."""
    context = spark.sparkContext
    context.setCheckpointDir(folder)
    try:
        yield
    finally:
        context.setCheckpointDir(_checkpoint_root(spark))
        remove(spark, folder)


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def loose_string(col: str) -> Column:
    """The same string, without Spark knowing how it is dealt out, so that a join moves both sides."""
    return F.concat(F.col(col), F.lit(""))


#: Anything but letters and digits separates words.
WORD_GAP = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-case words of a text, in order; none for null. JVM expressions only, linear in the text."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


#: Ids are broadcast only if they were counted to be no more than this (8 bytes each).
BROADCAST_IDS = 500_000


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, row): the whole row in one column, so that no name of it can clash, and an id for each row.

    Rows without an id get one below zero from their text, so that decisions about them take effect; those of equal texts share it."""
    made = F.xxhash64(F.lit("no id"), text_or_empty(text_col)).bitwiseOR(F.lit(-(1 << 63)))
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), made).alias("doc_id"), F.col(text_col).alias("text"), whole.alias("row"))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The whole rows of keyed ``rows`` whose id isn't among ``ids`` (one column)."""
    out = cut_lineage(ids.toDF("_gone").where("_gone is not null").distinct())
    return rows.join(F.broadcast(out) if out.count() <= BROADCAST_IDS else out, F.col("doc_id") == F.col("_gone"), "left_anti").select("row.*")
