"""Grouped counts, sums, shares and timelines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cents(column: str | Column) -> Column:
    """Money as an exact decimal, so that sums don't depend on order."""
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(18,2)")


def labelled(column: str, default: str = "Unknown") -> Column:
    return F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default))


def top_counts(df: DataFrame, key: Column, n: int, name: str = "label") -> DataFrame:
    """The n most frequent labels with their counts and places; ties by label."""
    counts = df.groupBy(key.alias(name)).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc(name)]
    return counts.orderBy(*order).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def top_sums(df: DataFrame, keys: list[str], amount: str, n: int) -> DataFrame:
    """The n largest sums by several keys, with their places."""
    sums = df.groupBy(*keys).agg(F.sum(cents(amount)).alias("amount"))
    order = [F.desc("amount"), *[F.asc(k) for k in keys]]
    return sums.orderBy(*order).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def percent_split(df: DataFrame, label: Column, amount: Column, name: str = "label") -> DataFrame:
    """Sum and rounded share of each label; labels without an amount go, and all go where the total isn't positive."""
    sums = df.groupBy(label.alias(name)).agg(F.sum(cents(F.coalesce(amount, F.lit(0.0)))).alias("amount"))
    total = sums.agg(F.sum("amount").alias("total")).scalar()
    out = sums.withColumn("_total", total).where((F.col("_total") > 0) & (F.col("amount") > 0))
    return out.select(name, "amount", F.floor(F.col("amount").cast("double") / F.col("_total").cast("double") * 100 + 0.5).cast("int").alias("pct"))


def recent(df: DataFrame, period: str, amount: str, n: int) -> DataFrame:
    """Sum over the n latest periods."""
    per = df.groupBy(period).agg(F.sum(cents(amount)).alias("amount"))
    return per.orderBy(F.desc(period)).limit(n).agg(F.sum("amount").alias("amount"), F.count("*").alias("periods"))


def majority_trend(df: DataFrame, key: str, direction: str) -> DataFrame:
    """growing or contracting if half of the informative children say so (growing first), else stable; unknown without any.

    ``unknown`` isn't informative; null is."""
    known = F.col(direction).isNull() | (F.col(direction) != "unknown")
    share = lambda d: F.count_if(known & F.coalesce(F.col(direction) == d, F.lit(False))) / F.nullif(F.count_if(known), F.lit(0))
    return df.groupBy(key).agg(
        F.when(F.count_if(known) == 0, "unknown").when(share("growing") >= 0.5, "growing").when(share("contracting") >= 0.5, "contracting").otherwise("stable").alias("trend"),
        F.count("*").alias("children"),
    )


def nested_counts(df: DataFrame, outer: str, inner: str, flag: Column) -> DataFrame:
    """Per outer key: total, flagged, and (inner, count) in order of inner as one array."""
    first = df.groupBy(outer, inner).agg(F.count("*").alias("n"), F.count_if(flag).alias("f"))
    return first.groupBy(outer).agg(F.sum("n").alias("total"), F.sum("f").alias("flagged"), F.array_sort(F.collect_list(F.struct(F.col(inner).alias("category"), F.col("n").alias("count")))).alias("categories"))


def month_spine(df: DataFrame, month: Column, as_of: str, months: int = 6) -> DataFrame:
    """Counts per month (first day); the last ``months`` months are there even with 0."""
    counts = df.groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    start = F.add_months(F.trunc(F.lit(as_of).cast("date"), "month"), -(months - 1))
    spine = df.sparkSession.range(1).select(F.explode(F.sequence(start, F.trunc(F.lit(as_of).cast("date"), "month"), F.expr("interval 1 month"))).alias("month"))
    return counts.join(spine, "month", "full_outer").select("month", F.coalesce("n", F.lit(0)).alias("n"))


def counted(df: DataFrame, children: DataFrame, key: str, foreign: str, name: str = "n") -> DataFrame:
    """Parents with the number of their children, 0 without any."""
    counts = children.groupBy(F.col(foreign).alias("_fk")).agg(F.count("*").alias(name))
    return df.join(counts, F.col(key) == F.col("_fk"), "left").drop("_fk").withColumn(name, F.coalesce(name, F.lit(0)))


def bundled(parents: DataFrame, key: str, children: Iterable[tuple[str, DataFrame, str, Column]]) -> DataFrame:
    """Parents with arrays of their children; each side is grouped before it joins, so rows don't multiply.

    children: (name, frame, foreign key, value)."""
    out = parents
    for name, frame, foreign, value in children:
        lists = frame.groupBy(F.col(foreign).alias("_fk")).agg(F.array_sort(F.collect_list(value)).alias(name))
        out = out.join(lists, F.col(key) == F.col("_fk"), "left").drop("_fk")
    return out


def outcomes(df: DataFrame, tag: str, names: list[str]) -> DataFrame:
    """Run statistics: one row with the count of each outcome."""
    return df.agg(*[F.count_if(F.col(tag) == n).alias(n) for n in names])
