"""Which of several rows stands for a key. All take an explicit order: no result depends on partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The row that comes first in ascending order within each key; nulls come last, as in the SQL.

    An aggregation, not a window: each task reduces its rows first, so a key that holds most rows
    costs one row per task in the shuffle. The order must be total within a key."""
    rest = [c for c in df.columns if c not in keys]
    columns = [F.col(o) if isinstance(o, str) else o for o in order]
    # Spark puts nulls first: what is null is asked before each value.
    ordered = F.struct(*[c.alias(f"_o{i}{n}") for i, o in enumerate(columns) for n, c in (("n", o.isNull()), ("", o))])
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), ordered).alias("_row")) if rest else df.distinct()
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def first_seen(df: DataFrame, key: str, arrival: list[str], blanks: bool = False) -> DataFrame:
    """The earliest row of each key; rows with a null or blank key are left out, unless ``blanks`` are keys too.

    A hash is never blank: where it is the key, blank values are to be left out before."""
    keyed = df if blanks else df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    return best_by(keyed, [key], list(arrival))


def by_source(sources: list[DataFrame], key: str, arrival: list[str], blanks: bool = False) -> DataFrame:
    """First seen across sources, in the order of the list, then of arrival."""
    tagged = [s.withColumn("source_rank", F.lit(i)) for i, s in enumerate(sources)]
    union = tagged[0]
    for t in tagged[1:]:
        union = union.unionByName(t)
    return first_seen(union, key, ["source_rank", *arrival], blanks)


def last_writer(df: DataFrame, key: str, score: str, arrival: str) -> DataFrame:
    """Rows are written by falling score, each over the one before: the lowest score stays, of equals the latest."""
    return best_by(df, [key], [F.col(score), -F.col(arrival)])


def first_k(df: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k rows of each key, with pos from 1. Spark stops ranking within each task beyond k."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("pos") <= k)


def distinct_in_order(column: Column, n: int = 20) -> Column:
    """Distinct elements of an array in order of appearance, n at most."""
    return F.slice(F.array_distinct(column), 1, n)
