"""Nearest neighbours against numpy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from bidweave.operators import neighbours
from bidweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def best():
    rows = pd.read_parquet(f"{SF}/embeddings.parquet")
    x = np.stack(rows.embedding).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(rows.vec_id % 100 == 0):
        likeness = x @ x[i]
        likeness[i] = -9
        out[int(rows.vec_id[i])] = [int(rows.vec_id[j]) for j in np.argsort(-likeness)[:10]]
    return out


def found(spark, name):
    out = {}
    for r in sorted(QUERIES[name].build(spark, SF).collect(), key=lambda r: r["pos"]):
        out.setdefault(r["query_id"], []).append(r["vec_id"])
    return out


def test_exact_search(spark, best):
    assert found(spark, "neural_search") == best


def test_odd_vectors(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, [None, 1.0]), (5, [0.0, 0.0]), (6, [0.0, -3.0]), (0, [1.0, 0.0])], "id int, v array<float>")
    got = [(r["id"], round(r["score"], 6)) for r in neighbours.exact_nearest(rows, rows.where("id = 1"), "id", "v", k=3).orderBy("pos").collect()]
    assert got == [(0, 1.0), (0, 1.0), (2, 1.0)]
    assert neighbours.exact_nearest(rows.limit(0), rows.limit(0), "id", "v").count() == 0
