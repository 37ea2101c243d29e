"""State in buckets of its key, so that a change rewrites the buckets that it touches and no others.

A bucket is a folder of one table, ``_bucket`` being its partition column. A change is merged by the pure functions of ``merge`` with the
rows of its buckets alone, and goes back by Spark's dynamic overwrite of partitions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from bidweave.operators import merge
from bidweave.storage import delete, scratch_folder

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class BucketedState:
    """A stored table of which equal ``keys`` share a bucket. One writer at a time; readers see whole buckets."""

    path: str
    keys: tuple[str, ...]
    buckets: int
    schema: StructType

    @classmethod
    def create(cls, rows: DataFrame, path: str, keys: Iterable[str], buckets: int) -> BucketedState:
        """Writes the first state. ``buckets`` bounds what one change of a row rewrites: let a bucket hold some 100 MB."""
        state = cls(path, tuple(keys), buckets, rows.schema)
        state._dealt(rows).write.partitionBy("_bucket").parquet(path)
        return state

    def bucket(self) -> Column:
        """The bucket of a row by its keys; null keys have one too."""
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _dealt(self, rows: DataFrame) -> DataFrame:
        # Rebalancing splits a bucket that many rows share over several tasks.
        return rows.select(*self.schema.names).withColumn("_bucket", self.bucket()).hint("rebalance", "_bucket")

    def _stored(self, spark: SparkSession, path: str) -> DataFrame:
        return spark.read.schema(StructType([*self.schema.fields, StructField("_bucket", IntegerType())])).parquet(path)

    def read(self, spark: SparkSession) -> DataFrame:
        return self._stored(spark, self.path).drop("_bucket")

    def apply(self, change: DataFrame, merged: Merge, touched: DataFrame | None = None) -> list[int]:
        """Replaces the buckets of the change by ``merged(their rows, change)``; returns their numbers.

        ``touched`` (rows with the keys) adds buckets that no row of the change lies in. ``merged`` must not move rows to other buckets. The new buckets are
        written aside first, so what is overwritten isn't what is read, and a run that ends in between can be repeated."""
        spark = change.sparkSession
        seen = change.select(*self.keys) if touched is None else change.select(*self.keys).unionByName(touched.select(*self.keys))
        hit = sorted(r[0] for r in seen.select(self.bucket().alias("b")).distinct().collect())  # no more than there are buckets
        if not hit:
            return []
        state = self._stored(spark, self.path).where(F.col("_bucket").isin(hit)).drop("_bucket")
        aside = scratch_folder(spark)
        self._dealt(merged(state, change)).write.mode("overwrite").partitionBy("_bucket").parquet(aside)
        fresh = self._stored(spark, aside)
        left = {r[0] for r in fresh.select("_bucket").distinct().collect()}
        fresh.hint("rebalance", "_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        for emptied in set(hit) - left:
            delete(spark, f"{self.path}/_bucket={emptied}")
        delete(spark, aside)
        return hit

    def upsert(self, change: DataFrame, keep: Iterable[str] = ()) -> list[int]:
        """``merge.upserted`` by the only key. Applying one change twice gives what once gives."""
        (key,) = self.keys
        return self.apply(change, lambda state, rows: merge.upserted(state, rows, key, keep))

    def replace(self, fresh: DataFrame, touched: DataFrame) -> list[int]:
        """``merge.replaced_partitions``: the rows of the touched keys go, the fresh ones come, also where none is left."""
        return self.apply(fresh, lambda state, rows: merge.replaced_partitions(state, rows, list(self.keys), touched), touched)

    def delete(self, gone: DataFrame) -> list[int]:
        """Drops the rows of these keys."""
        return self.apply(gone.select(*self.keys), lambda state, rows: state.join(rows.distinct(), list(self.keys), "left_anti"))
