"""Nearest neighbours of stated query vectors among all rows, exactly, in cells of some rows and some queries."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows and query vectors of a cell, about: what a task holds at a time.
ROWS = 16_384
BLOCK = 2_048
#: Query vectors that meet a cell's rows at a time.
AT_ONCE = 8


def _units(vectors: pa.ChunkedArray) -> np.ndarray:
    """The vectors as columns of length one; a zero vector stays, so that it is like none."""
    v = np.ascontiguousarray(vectors.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), -1).T)
    squares = np.zeros(v.shape[1])
    for x in v:
        squares += x * x
    length = np.sqrt(squares)
    return v / np.where(length > 0, length, 1.0)


def _nearest_in_cell(k: int):
    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        """The ``k`` best rows of each query. Products are summed in the order of the dimensions, so that a score is the same in every cell."""
        rows = rows.sort_by("id")
        ids, queries = rows["id"].to_numpy(), asked["query"].to_numpy()
        found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
        if len(ids) and len(queries):
            v, q = _units(rows["v"]), _units(asked["q"])
            own = list(zip(np.searchsorted(ids, queries, "left"), np.searchsorted(ids, queries, "right"), strict=True))
            for start in range(0, len(queries), AT_ONCE):
                score = np.zeros((min(AT_ONCE, len(queries) - start), len(ids)))
                product = np.empty_like(score)
                for x, y in zip(q[:, start : start + AT_ONCE], v, strict=True):
                    np.multiply(x[:, None], y, out=product)
                    score += product
                score[np.isnan(score)] = np.inf  # the largest, as Spark orders it
                for i, (first, end) in enumerate(own[start : start + AT_ONCE]):
                    score[i, first:end] = -np.inf
                least = np.partition(score, -k, axis=1)[:, [-k]] if len(ids) > k else -np.inf
                at, row = np.nonzero((score >= least) & (score > -np.inf))
                best = np.lexsort((row, -score[at, row], at))
                at, row = at[best], row[best]
                kept = np.arange(len(at)) - np.searchsorted(at, at) < k
                at, row = at[kept], row[kept]
                found.append((at + start, row, score[at, row]))
        at, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
        return pa.table({"query": asked["query"].take(at), "id": rows["id"].take(row), "score": np.where(np.isinf(score), np.nan, score)})

    return run


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The k best of each query: Spark limits them in each task before the shuffle."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return pairs.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k).select("query", "pos", "id", "score")


def _usable(rows: DataFrame, key: str, vector: str, id_as: str, vector_as: str) -> DataFrame:
    usable = F.col(key).isNotNull() & F.col(vector).isNotNull() & ~F.exists(F.coalesce(F.col(vector), F.array()), lambda x: x.isNull())
    return rows.where(usable).select(F.col(key).alias(id_as), F.col(vector).cast("array<double>").alias(vector_as), F.size(vector).alias("dimensions"))


def exact_nearest(rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10) -> DataFrame:
    """(query, pos, id, score): for each query the ``k`` other rows of largest cosine, ties by id.

    Every row meets every query, which is what an exact answer costs: in cells of some ``ROWS`` rows and ``BLOCK`` queries, each of which
    gives its own best. Vectors that are null or hold a null take no part; those of different dimensions don't meet."""
    parts, blocks = max(1, math.ceil(rows.count() / ROWS)), max(1, math.ceil(queries.count() / BLOCK))
    share = lambda of, n: F.pmod(F.xxhash64(*of), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    met = _usable(rows, key, vector, "id", "v").withColumn("part", share(["id", "v"], parts)).withColumn("block", every(blocks))
    asked = _usable(queries, key, vector, "query", "q").withColumn("block", share(["query", "q"], blocks)).withColumn("part", every(parts))
    cell = ["dimensions", "part", "block"]
    schema = f"query {queries.schema[key].dataType.simpleString()}, id {rows.schema[key].dataType.simpleString()}, score double"
    return _best(met.groupBy(cell).cogroup(asked.groupBy(cell)).applyInArrow(_nearest_in_cell(k), schema), k)
