"""Joins by alias, by containment and by first match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.operators.containment import containing, few, fingerprint, first_held
from bidweave.operators.dedupe import best_by


def by_alias(rows: DataFrame, name: str, dimension: DataFrame, aliases: str, key: str) -> DataFrame:
    """Equality join on trimmed lower-case names over the aliases of a dimension; the first alias in order wins."""
    flat = dimension.select(key, F.posexplode(aliases).alias("ordinal", "_alias")).withColumn("_alias", F.lower(F.trim("_alias")))
    first = best_by(flat, ["_alias"], ["ordinal", key]).drop("ordinal")
    return rows.join(first, F.lower(F.trim(F.col(name))) == F.col("_alias"), "left").drop("_alias")


def without_existing(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    return rows.join(state.select(*keys), keys, "left_anti")


def contained_place(rows: DataFrame, text: str, places: DataFrame) -> DataFrame:
    """The place (id, city, state, ordinal) that a lower-case text mentions, as ``place_id``.

    The first city wins at once; without one, the last state. Names are found through an index (``containment``), so neither
    texts nor places are compared each with each, however many there are; equal texts are looked at once. Few names are looked for in order."""
    # Of the places of one name only the one that would be chosen matters.
    named = lambda kind, choose: places.groupBy(F.lower(kind).alias("name")).agg(choose(F.struct("ordinal", "id")).alias("place")).select(F.lit(kind).alias("kind"), "name", "place")
    names = named("city", F.min).unionByName(named("state", F.max))
    if (found := few(names.select("name", F.struct("kind", "place").alias("v")), "name", "v")) is not None:
        of = lambda kind: [(n, inner, v["place"]["id"]) for n, inner, v in found if v["kind"] == kind]
        id_type = places.schema["id"].dataType.simpleString()
        return rows.withColumn("place_id", F.coalesce(first_held(text, of("city"), id_type), first_held(text, of("state")[::-1], id_type)))
    hits = containing(rows, text, names, "name")
    of = lambda kind: F.when(F.col("kind") == kind, F.col("place"))
    chosen = hits.groupBy("fingerprint").agg(F.min(of("city")).alias("city"), F.max(of("state")).alias("state"))
    chosen = chosen.select(F.col("fingerprint").alias("_fingerprint"), F.coalesce("city.id", "state.id").alias("place_id"))
    return rows.withColumn("_fingerprint", fingerprint(text)).join(chosen, "_fingerprint", "left").drop("_fingerprint")


def first_match(rows: DataFrame, host: str, portals: DataFrame, default: str) -> DataFrame:
    """The first portal (ordinal, domain, name) whose domain a host contains, else the default. Hosts meet many domains through an index."""
    domains = portals.groupBy("domain").agg(F.min(F.struct("ordinal", "name")).alias("place"))
    if (found := few(domains, "domain", "place")) is not None:
        named = [(domain, inner, place["name"]) for domain, inner, place in found]
        return rows.withColumn("portal", F.coalesce(first_held(host, named, "string"), F.lit(default)))
    hits = containing(rows, host, domains, "domain")
    chosen = hits.groupBy(F.col("fingerprint").alias("_fingerprint")).agg(F.min("place").alias("_place"))
    joined = rows.withColumn("_fingerprint", fingerprint(host)).join(chosen, "_fingerprint", "left")
    return joined.withColumn("portal", F.coalesce("_place.name", F.lit(default))).drop("_fingerprint", "_place")


def labelled(rows: DataFrame, code: str, labels: DataFrame, default: str) -> DataFrame:
    """Code to label through a dimension (code, label); Spark chooses the join by its size."""
    return rows.join(labels.withColumnRenamed("code", code), code, "left").withColumn("label", F.coalesce("label", F.lit(default)))


def as_of(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """Each left row with the value of the latest right row of its key at or before its time.

    Both sides are one stream per key in time order, and the last value seen is carried along: one
    shuffle, no pairs. Of right rows at one time the largest value counts."""
    from pyspark.sql import Window

    rest = [c for c in left.columns if c not in (key, ts)]
    marks = right.groupBy(key, ts).agg(F.max(value).alias(value)).select(key, ts, F.lit(0).alias("_side"), value, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest])
    rows = left.select(key, ts, F.lit(1).alias("_side"), F.lit(None).cast(right.schema[value].dataType).alias(value), *rest)
    order = Window.partitionBy(key).orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return marks.unionByName(rows).withColumn(value, F.last(value, ignorenulls=True).over(order)).where("_side = 1").drop("_side")


def in_range(points: DataFrame, value: str, ranges: DataFrame, lo: str, hi: str, width: float) -> DataFrame:
    """Pairs with lo <= value < hi, by equality of buckets: a range has a row in every bucket that it meets.

    Points meet each distinct range once, and then the rows of that range by equality. That join is by sorting, so the pairs of a
    range lie together, each of its points with the same rows in the same order: pairs grow with the product of both sides, and
    such repeats take little room where they are written. ``width`` should be near the ranges' usual length; it changes the cost only."""
    bucket = lambda c: F.floor(c / width)
    proper = ranges.where(F.col(hi) > F.col(lo))
    cut = proper.select(F.col(lo).alias("_lo"), F.col(hi).alias("_hi")).distinct().withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_lo")), bucket(F.col("_hi")))))
    met = points.withColumn("_bucket", bucket(F.col(value))).join(cut, "_bucket").where((F.col(value) >= F.col("_lo")) & (F.col(value) < F.col("_hi"))).drop("_bucket")
    return met.join(proper.hint("merge"), (F.col("_lo") == F.col(lo)) & (F.col("_hi") == F.col(hi))).drop("_lo", "_hi")
