"""Names that are spelled a little differently: similarity by edits, found by equality of segments.

The shorter of two similar names has one segment of the longer one unchanged, near its own place, if that is cut into one segment
more than its length allows edits. So names give a row for each of their own segments, and one for each place where a segment of a
longer similar name may lie; both meet by equality. All similar pairs are found (recall 1), each from its shorter name only; the
edits are counted inside the join, no further than allowed, so no other pair leaves a task.
Rows grow with the cube of a name's length: this is for names, not for texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of the longer name's characters, in percent, that need no edit.
SIMILAR = 85


def _segments(names: DataFrame, percent: int) -> DataFrame:
    """(size, part, piece, long): the segments of each name, one more than the edits that it allows to shorter ones."""
    sized = names.select(F.col("name").alias("long"), F.length("name").alias("size"), F.expr(f"{100 - percent} * length(name) div 100").alias("edits"))
    cut = sized.select("*", F.explode(F.expr("sequence(0L, edits)")).alias("part")).withColumns({"lo": F.expr("part * size div (edits + 1)"), "hi": F.expr("(part + 1) * size div (edits + 1)")})
    return cut.select("size", "part", F.expr("substring(long, int(lo) + 1, int(hi - lo))").alias("piece"), "long")


def _places(names: DataFrame, percent: int, longer: int) -> DataFrame:
    """(size, part, piece, short): what stands where a segment of a similar name of ``size`` characters, at least ``longer`` more, may stand.

    A segment is looked for only as far from its place as the edits before it, and those after it, allow."""
    sized = names.select(F.col("name").alias("short"), F.length("name").alias("own"))
    sizes = sized.withColumn("most", F.expr(f"100 * own div {percent}")).where(f"own + {longer} <= most").select("*", F.explode(F.expr(f"sequence(own + {longer}, int(most))")).alias("size"))
    edits = sizes.withColumn("edits", F.expr(f"{100 - percent} * size div 100"))
    parts = edits.select("*", F.explode(F.expr("sequence(0L, edits)")).alias("part"))
    cut = parts.withColumns({"lo": F.expr("part * size div (edits + 1)"), "wide": F.expr("(part + 1) * size div (edits + 1) - part * size div (edits + 1)")})
    first = F.expr("greatest(0L, lo - part, lo + own - size - (edits - part))")
    last = F.expr("least(own - wide, lo + part, lo + own - size + (edits - part))")
    near = cut.withColumns({"first": first, "last": last}).where("first <= last")
    placed = near.select("*", F.explode(F.expr("sequence(first, last)")).alias("at"))
    return placed.select("size", "part", F.expr("substring(short, int(at) + 1, int(wide))").alias("piece"), "short")


def _met(shorter: DataFrame, longer: DataFrame, percent: int, by: int = 0) -> DataFrame:
    """(short, long): each distinct similar pair of which the second is at least ``by`` characters longer."""
    close = F.expr(f"levenshtein(short, long, int({100 - percent} * length(long) div 100)) >= 0")
    return _places(shorter, percent, by).join(_segments(longer, percent), ["size", "part", "piece"]).where(close).select("short", "long").distinct()


def _named(rows: DataFrame, column: str) -> DataFrame:
    return rows.where(F.col(column) != "").select(F.col(column).alias("name")).distinct()


def similar(names: DataFrame, aliases: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """(name, alias, edits) for the distinct names and aliases of which ``percent`` of the longer one needs no edit.

    names has a column ``name``, aliases a column ``alias``; null and empty ones are similar to none."""
    left, right = _named(names, "name"), _named(aliases, "alias")
    longer = _met(left, right, percent).select(F.col("short").alias("name"), F.col("long").alias("alias"))
    shorter = _met(right, left, percent, by=1).select(F.col("long").alias("name"), F.col("short").alias("alias"))
    return longer.unionByName(shorter).withColumn("edits", F.levenshtein("name", "alias"))


def similar_among(names: DataFrame, percent: int = SIMILAR) -> DataFrame:
    """(name, alias) as ``similar`` has them, for names among themselves: a pair of different lengths is found once and given both ways."""
    each = _named(names, "name")
    both = F.expr("IF(length(short) < length(long), array(struct(short AS name, long AS alias), struct(long AS name, short AS alias)), array(struct(short AS name, long AS alias)))")
    return _met(each, each, percent).select(F.explode(both).alias("pair")).select("pair.*")


def by_similar_alias(rows: DataFrame, name: str, dimension: DataFrame, aliases: str, key: str, percent: int = SIMILAR) -> DataFrame:
    """Left join of rows with the key of the most similar alias (least edits, then the first in order, then the least key) on trimmed lower-case names."""
    flat = dimension.select(F.col(key).alias("_key"), F.posexplode(aliases).alias("_ordinal", "_alias")).withColumn("_alias", F.lower(F.trim("_alias")))
    first = flat.groupBy("_alias").agg(F.min(F.struct("_ordinal", "_key")).alias("_best"))
    clean = F.lower(F.trim(F.col(name)))
    found = similar(rows.select(clean.alias("name")), first.select(F.col("_alias").alias("alias")), percent)
    best = found.join(first, F.col("alias") == F.col("_alias")).groupBy(F.col("name").alias("_name")).agg(F.min(F.struct("edits", "_best")).alias("_found"))
    return rows.join(best, clean == F.col("_name"), "left").withColumn(key, F.col("_found._best._key")).drop("_name", "_found")


def resolved(rows: DataFrame, name: str, percent: int = SIMILAR) -> DataFrame:
    """Adds ``entity``, the commonest name similar to the row's (ties: the least), and ``n_similar``, how many distinct names are.

    Null and empty names have none."""
    counts = rows.where(F.col(name) != "").groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    found = similar_among(counts.select(F.col("_name").alias("name")), percent)
    ranked = found.join(counts, F.col("alias") == F.col("_name")).groupBy("name").agg(F.min(F.struct(-F.col("_n"), "alias")).alias("best"), F.count("*").alias("n_similar"))
    known = ranked.select(F.col("name").alias("_name"), F.col("best.alias").alias("entity"), "n_similar")
    return rows.join(known, F.col(name) == F.col("_name"), "left").drop("_name")
