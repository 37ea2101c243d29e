"""Writes to bucketed states: what they give, and which files they touch."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import functions as F

from bidweave.operators import merge
from bidweave.operators.bucketed import BucketedState


def files(path) -> dict[str, set[str]]:
    return {p.name: {f.name for f in p.glob("*.parquet")} for p in Path(path).glob("_bucket=*")}


def customers(spark):
    return spark.range(2000).select("id", F.concat(F.lit("c"), "id").alias("title"), F.lit("pursue").alias("tag"))


def test_an_upsert_rewrites_its_buckets_only(spark, tmp_path, rows_of):
    path = str(tmp_path / "s")
    rows = customers(spark)
    state = BucketedState.create(rows, path, ["id"], 32)
    before = files(path)
    change = spark.createDataFrame([(5, None, "x"), (77, "new", "x"), (5000, "added", "y")], "id long, title string, tag string")
    hit = state.upsert(change, ["tag"])
    after = files(path)
    assert 0 < len(hit) <= 3 and len(before) == 32
    assert {b for b in after if after[b] != before.get(b)} == {f"_bucket={b}" for b in hit}
    assert rows_of(state.read(spark)) == rows_of(merge.upserted(rows, change, "id", ["tag"]))
    assert state.upsert(change, ["tag"]) == hit and rows_of(state.read(spark)) == rows_of(merge.upserted(rows, change, "id", ["tag"]))
    assert state.upsert(change.limit(0)) == []


def test_replaced_keys_may_leave_nothing(spark, tmp_path, rows_of):
    path = str(tmp_path / "s")
    rows = spark.createDataFrame([(i, g) for i in range(60) for g in ("a", "b", None)], "n int, g string")
    state = BucketedState.create(rows, path, ["g"], 64)
    touched = spark.createDataFrame([("a",), ("zz",)], "g string")
    fresh = spark.createDataFrame([(1, "new")], "n int, g string")
    state.replace(fresh, touched)
    assert rows_of(state.read(spark)) == rows_of(merge.replaced_partitions(rows, fresh, ["g"], touched).select("n", "g"))
    state.replace(fresh.limit(0), spark.createDataFrame([("b",), ("new",)], "g string"))
    assert {r["g"] for r in state.read(spark).collect()} == {None}


def test_deletes_down_to_an_empty_state(spark, tmp_path):
    state = BucketedState.create(customers(spark).limit(40), str(tmp_path / "s"), ["id"], 4)
    state.delete(spark.range(10, 4000))
    assert sorted(r["id"] for r in state.read(spark).collect()) == list(range(10))
    state.delete(spark.range(4000))
    assert state.read(spark).count() == 0
    state.upsert(customers(spark).limit(1))
    assert state.read(spark).count() == 1


def test_the_state_is_read_by_bucket(spark, tmp_path):
    """What a change reads is pruned to its buckets."""
    from .test_plans import plan

    state = BucketedState.create(customers(spark), str(tmp_path / "s"), ["id"], 16)
    seen = []
    state.apply(customers(spark).limit(1), lambda old, new: (seen.append(plan(old)), merge.upserted(old, new, "id"))[1])
    assert "PartitionFilters: [isnotnull(_bucket" in seen[0] or "PartitionFilters: [_bucket" in seen[0]


def test_maintained_counts_equal_a_recount(spark, tmp_path, rows_of):
    """Inserts, deletes, moves, rows that stay, and parents that nobody knows."""
    parents = spark.createDataFrame([(p, n) for p, n in ((1, 2), (2, 1), (3, 0), (4, None))], "id int, n long")
    changes = spark.createDataFrame([(1, None), (1, 2), (None, 3), (None, 3), (2, 2), (None, 9), (9, 4), (None, None)], "was int, is int")
    state = BucketedState.create(parents, str(tmp_path / "s"), ["id"], 8)
    deltas = merge.signed_deltas(changes, "was", "is")
    assert rows_of(deltas) == [(1, -2), (2, 1), (3, 2), (4, 1)]
    hit = state.apply(deltas.withColumnRenamed("parent", "id"), lambda old, d: merge.counts_maintained(old, d.withColumnRenamed("id", "parent"), "id", "n"))
    assert len(hit) <= 4 and rows_of(state.read(spark)) == [(1, 0), (2, 2), (3, 2), (4, 1)]
