"""Connected components over edge tables, by lowering labels and following them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import cut_lineage


def loose(col: str) -> Column:
    """The same long value, without Spark knowing how it is dealt out.

    A join on it moves both sides, so that adaptive execution can split a hot key."""
    return F.col(col).bitwiseXOR(F.lit(0).cast("bigint"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), both long; label is the least node reachable.

    Every round a node takes the least label among its neighbours, then the label of its
    label, so chains shrink by half or better. Hubs are joined over slim rows, with
    partial minima before the shuffle. Labels only fall, so
    rounds end: when none changes."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        near = both.select("a", loose("b").alias("b")).join(labels.select(loose("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("m"))
        lowered = cut_lineage(labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("m", "label")).alias("label")))
        target = lowered.select(loose("node").alias("at"), F.col("label").alias("next"))
        labels_now = lowered.select("node", "old", loose("label").alias("at")).join(target, "at").select("node", "old", F.col("next").alias("label"))
        labels_now = cut_lineage(labels_now)
        changed = labels_now.where("label <> old").limit(1).count()
        labels = labels_now.select("node", "label")
        if not changed:
            return labels
