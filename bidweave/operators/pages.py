"""Deep pages: rows stored once in ranges of their order, so that a page reads the ranges that it lies in.

``filters.page`` orders all that comes before a page; here that is done once, when the ranges are written. A page by number
looks its ranges up in their counts; the page after a given row (keyset) is a filter on the order's columns.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGES = 64


@dataclass(frozen=True)
class Pages:
    """folder: where the ranges lie; order: (column, descending) pairs; before: rows ahead of each range, and their number in all at the end."""

    folder: str
    order: tuple[tuple[str, bool], ...]
    before: tuple[int, ...]
    schema: T.StructType

    @property
    def total(self) -> int:
        return self.before[-1]


def _sorting(order: tuple[tuple[str, bool], ...]) -> list[Column]:
    return [F.desc_nulls_last(c) if down else F.asc_nulls_first(c) for c, down in order]


def store(df: DataFrame, order: list[tuple[str, bool]], folder: str, ranges: int = RANGES) -> Pages:
    """Writes the rows in ``ranges`` ranges of their order, as Spark sorts it (nulls first, or last where descending).

    The order should be total, as for every page; rows that are equal in it lie in one range. The driver gets one count for each range."""
    sorting = _sorting(tuple(order))
    cut = df.repartitionByRange(ranges, *sorting).withColumn("_range", F.spark_partition_id())
    cut.sortWithinPartitions(*sorting).write.partitionBy("_range").parquet(folder)
    counts = dict(_rows(df.sparkSession, folder, cut.schema).groupBy("_range").count().collect())
    before = [0]
    for i in range(ranges):
        before.append(before[-1] + counts.get(i, 0))
    return Pages(folder, tuple(order), tuple(before), cut.schema)


def _rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    # Without rows there is no file to take the columns from.
    return spark.read.schema(schema).parquet(folder)


def page_at(spark: SparkSession, pages: Pages, number: int = 1, size: int = 50) -> DataFrame:
    """The page as ``filters.page`` gives it, with pos and total, from the ranges that it lies in (one, or two at a border)."""
    size, number = max(1, size), max(1, number)
    first = (number - 1) * size
    met = [i for i in range(len(pages.before) - 1) if pages.before[i] < first + size and pages.before[i + 1] > first]
    ahead = pages.before[met[0]] if met else 0
    sorting = _sorting(pages.order)
    # Only the rows up to the page's end inside its ranges are ordered.
    top = _rows(spark, pages.folder, pages.schema).where(F.col("_range").isin(met)).drop("_range").orderBy(*sorting).offset(first - ahead if met else 0).limit(size)
    placed = top.withColumn("pos", F.row_number().over(Window.orderBy(*sorting)) + F.lit(first))
    return placed.withColumn("total", F.lit(pages.total).cast("bigint"))


def page_after(df: DataFrame, order: list[tuple[str, bool]], last: list, size: int = 50) -> DataFrame:
    """The rows that follow a given one: ``last`` holds its values of the order's columns. A filter and a top-k, however deep; the columns must have no nulls."""
    steps = []
    for i, (c, down) in enumerate(order):
        same = reduce(lambda a, b: a & b, [F.col(k) == v for (k, _), v in zip(order[:i], last)], F.lit(True))
        steps.append(same & (F.col(c) < last[i] if down else F.col(c) > last[i]))
    # The first column's bound alone reaches the scan.
    (c, down), bound = order[0], last[0]
    ahead = F.col(c) <= bound if down else F.col(c) >= bound
    return df.where(ahead & reduce(or_, steps)).orderBy(*_sorting(tuple(order))).limit(size)
