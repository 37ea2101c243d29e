"""Writes as pure functions: (state, change) to the new state. Keys of the result are unique if those of the state are."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.text import blank_to_null
from bidweave.operators.dedupe import best_by


def prepared(df: DataFrame, texts: Iterable[str], defaults: dict[str, str] | None = None) -> DataFrame:
    """Rows ready for insertion: texts trimmed, blank ones null, then defaults."""
    out = df.withColumns({c: blank_to_null(c) for c in texts})
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in (defaults or {}).items()})


def insert_missing(state: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Appends the rows whose key is new; existing rows stay as they are."""
    return state.unionByName(rows.join(state.select(key), key, "left_anti"))


def patched(state: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Sets the columns that a patch row provides. ``has_c`` says whether c is provided; a blank then becomes null."""
    columns = [c for c in state.columns if c != key and f"has_{c}" in patch.columns]
    p = patch.select(key, *[F.col(c).alias(f"_{c}") for c in columns], *[F.col(f"has_{c}") for c in columns])
    joined = state.join(p, key, "left")
    return joined.select(*[F.when(F.coalesce(F.col(f"has_{c}"), F.lit(False)), F.nullif(F.col(f"_{c}"), F.lit(""))).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in state.columns])


def upserted(state: DataFrame, change: DataFrame, key: str, keep: Iterable[str] = ()) -> DataFrame:
    """Incoming values win unless null; the columns of ``keep`` keep a value that they have. New keys are added."""
    kept = set(keep)
    s = state.select(F.col(key), *[F.col(c).alias(f"_s_{c}") for c in state.columns if c != key])
    joined = s.join(change.select(key, *[F.col(c).alias(f"_c_{c}") for c in state.columns if c != key and c in change.columns]), key, "full_outer")

    def merged(c: str) -> Column:
        if c not in change.columns:
            return F.col(f"_s_{c}")
        pair = (f"_s_{c}", f"_c_{c}") if c in kept else (f"_c_{c}", f"_s_{c}")
        return F.coalesce(*map(F.col, pair))

    return joined.select(*[F.col(key) if c == key else merged(c).alias(c) for c in state.columns])


def last_values(change: DataFrame, key: str, arrival: str) -> DataFrame:
    """The latest row of each key, for key-value upserts."""
    return best_by(change, [key], [-F.col(arrival)])


def replaced_partitions(state: DataFrame, fresh: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """Drops the partitions of ``touched`` (distinct keys) and adds the fresh rows: one commit, no gap between."""
    return state.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def deleted(state: DataFrame, predicate: Column) -> DataFrame:
    """All rows but those for which the predicate is true."""
    return state.where(~F.coalesce(predicate, F.lit(False)))


def cascaded(parents: DataFrame, children: DataFrame, gone: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children without those keys."""
    ids = gone.select(F.col(key).alias("_gone")).distinct()
    return parents.join(ids, F.col(key) == F.col("_gone"), "left_anti"), children.join(ids, F.col(foreign) == F.col("_gone"), "left_anti")


def written_back(parents: DataFrame, rolled: DataFrame, key: str, columns: Iterable[str]) -> DataFrame:
    """Roll-ups onto their parents; a parent without one keeps its old values."""
    chosen = set(columns)
    joined = parents.join(rolled.select(key, *[F.col(c).alias(f"_{c}") for c in chosen]), key, "left")
    return joined.select(*[F.coalesce(F.col(f"_{c}"), F.col(c)).alias(c) if c in chosen else F.col(c) for c in parents.columns])


def signed_deltas(changes: DataFrame, before: str, after: str) -> DataFrame:
    """(parent, delta) of changed children: each counts one less where it was, one more where it is now.

    A null ``before`` is an insert, a null ``after`` a delete, two parents a move; one that stays where it is changes nothing."""
    sides = F.array(F.struct(F.col(before).alias("parent"), F.lit(-1).alias("by")), F.struct(F.col(after).alias("parent"), F.lit(1).alias("by")))
    moved = changes.select(F.explode(sides).alias("s")).select("s.*").where("parent IS NOT NULL")
    return moved.groupBy("parent").agg(F.sum("by").alias("delta")).where("delta <> 0")


def counts_maintained(parents: DataFrame, deltas: DataFrame, key: str, count: str) -> DataFrame:
    """Stored counts with the deltas added, instead of counting all children again; a missing count is 0. Deltas of unknown parents go nowhere."""
    joined = parents.join(deltas.withColumnRenamed("parent", "_parent"), F.col(key) == F.col("_parent"), "left")
    fresh = F.coalesce(F.col(count), F.lit(0)) + F.coalesce("delta", F.lit(0))
    return joined.select(*[fresh.cast(parents.schema[count].dataType).alias(c) if c == count else F.col(c) for c in parents.columns])


def set_key(old: Column, key: Column, value: Column) -> Column:
    """A map with one key set."""
    return F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(key, value))


def backfilled(state: DataFrame, found: DataFrame, key: str, columns: Iterable[str], missing: dict[str, str] | None = None) -> DataFrame:
    """Fills columns that are null (or equal the given marker) with found values; ``filled`` counts those set."""
    marks = missing or {}
    chosen = list(columns)
    joined = state.join(found.select(key, *[F.col(c).alias(f"_{c}") for c in chosen]), key, "left")
    lacks = {c: F.col(c).isNull() | ((F.col(c) == marks[c]) if c in marks else F.lit(False)) for c in chosen}
    sets = {c: lacks[c] & F.col(f"_{c}").isNotNull() for c in chosen}
    return joined.select(*[F.when(sets[c], F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in chosen else F.col(c) for c in state.columns], sum((sets[c].cast("int") for c in chosen), F.lit(0)).alias("filled"))
