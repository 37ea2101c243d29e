"""Case-insensitive pattern search through a stored table of trigrams.

``build`` writes two tables: the rows, dealt out by key into slices, and postings (gram, key, slice), dealt out by gram into shelves and sorted
by gram. ``search`` reads the shelves of the pattern's trigrams only, keeps the keys that have all of them, reads the slices where such
keys lie, and compares these rows with the whole pattern. So an answer costs what its trigrams cost, not the table.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.operators.filters import any_ilike

GRAM = 3
#: Trigrams that a search looks up at most: those furthest apart; the comparison decides anyway.
LOOKED_UP = 8


def _trigrams(text: Column) -> Column:
    """Distinct trigrams of a lower-case text: a look ahead from each character, none of which is half of a pair."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?s)(?=(\P{Cs}..))"), F.lit(1)))


def shelf_of(gram: str, shelves: int) -> int:
    """The shelf of a trigram, as ``build`` deals them out."""
    return zlib.crc32(gram.encode()) % shelves


@dataclass(frozen=True)
class TextIndex:
    """Where the tables lie, and how they are cut."""

    folder: str
    key: str
    columns: tuple[str, ...]
    shelves: int
    slices: int

    def postings(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/postings")

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.folder}/rows")


def build(rows: DataFrame, key: str, columns: list[str], folder: str, shelves: int = 32, slices: int = 16) -> TextIndex:
    """Writes the index of the columns' texts. Shelves and slices are folders, to be chosen so that a file of them is worth reading: grow them with the table.

    A trigram of a third of all rows is a third of the rows in its shelf, in as many files as tasks hold it. Null texts have no
    trigrams; a repeated key is several rows, found together."""
    cut = rows.withColumn("_slice", F.pmod(F.xxhash64(key), F.lit(slices)).cast("int"))
    cut.write.partitionBy("_slice").parquet(f"{folder}/rows")
    grams = F.array_distinct(F.flatten(F.array(*[_trigrams(F.lower(F.coalesce(F.col(c), F.lit("")))) for c in columns])))
    posted = cut.select(F.explode(grams).alias("gram"), F.col(key).alias("key"), "_slice")
    shelved = posted.withColumn("_shelf", F.pmod(F.crc32(F.encode("gram", "UTF-8")), F.lit(shelves)).cast("int"))
    # Dealt out by shelf and key, so that a hot trigram fills several tasks; sorted, so that row groups hold few trigrams.
    shelved.repartition("_shelf", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("_shelf", "gram").write.partitionBy("_shelf").parquet(f"{folder}/postings")
    return TextIndex(folder, key, tuple(columns), shelves, slices)


def literal_runs(pattern: str) -> list[str]:
    """What a LIKE pattern asks for letter by letter: the pieces between its wildcards."""
    runs, escaped = [""], False
    for c in pattern:
        if escaped:
            runs[-1] += c
            escaped = False
        elif c == "\\":
            escaped = True
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
    return [r for r in runs if r]


def wanted(pattern: str) -> list[str]:
    """Trigrams that every match of the pattern has. Only those of ASCII are used: their lower case is the same everywhere."""
    found = sorted({r[i : i + GRAM] for r in map(str.lower, literal_runs(pattern)) for i in range(len(r) - GRAM + 1)})
    plain = [g for g in found if g.isascii()]
    step = max(1, len(plain) // LOOKED_UP)
    return plain[::step][:LOOKED_UP]


def search(spark: SparkSession, index: TextIndex, term: str) -> DataFrame:
    """The rows of which some column has the term, as ``any_ilike`` finds them: wildcards in the term stay wildcards.

    A term without three letters in a row can't be looked up and is compared with all rows, with the same result."""
    rows, grams = index.rows(spark), wanted(term)
    compared = any_ilike(term, *index.columns)
    columns = [c for c in rows.columns if c != "_slice"]
    if not grams:
        return (rows if compared is None else rows.where(compared)).select(*columns)
    shelves = sorted({shelf_of(g, index.shelves) for g in grams})
    posted = index.postings(spark).where(F.col("_shelf").isin(shelves) & F.col("gram").isin(grams))
    # All trigrams lie in one column or another of the row; the comparison asks for one column with all of them.
    keys = posted.groupBy("key", "_slice").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams)).select(F.col("key").alias("_key"), F.col("_slice").alias("_of"))
    same = (F.col("_slice") == F.col("_of")) & F.col(index.key).eqNullSafe(F.col("_key"))
    return rows.join(keys, same, "left_semi").where(compared).select(*columns)

