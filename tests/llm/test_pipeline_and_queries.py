from __future__ import annotations

import base64
import hashlib
import re

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from bidweave.llm import catalog

from .test_dedup import brute_classes
from .test_text_operators import brute_hits

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = con.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    df = catalog.queries()[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*columns).collect()))) == sorted(map(repr, found.fetchall()))


def test_every_operator_has_a_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in catalog.queries()) == list(range(1, 14))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns


def test_pipeline_equals_brute_force(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    docs = docs[docs.text.fillna("").map(lambda t: any(c.isalpha() for c in t))]
    docs = docs.sort_values("doc_id").drop_duplicates("text", keep="last")
    rows = list(zip(docs.doc_id.tolist(), docs.text.tolist()))
    classes = brute_classes(rows)
    rows = [(d, t) for d, t in rows if classes[d][0] == d]
    items = pd.read_parquet(f"{SF}/benchmark.parquet")
    leaks = {h[0] for h in brute_hits(rows, list(zip(items.item_id.tolist(), items.text.tolist())))}
    want = {d: enc.encode_ordinary(t) for d, t in rows if d not in leaks}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    for d, ids in want.items():
        assert got[d]["ids"] == ids
        assert got[d]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_pipeline_of_no_documents(spark):
    out = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    assert out.count() == 0


def test_pipeline_with_nulls_and_repeats(spark):
    rows = [(1, None, "en"), (2, "", None), (3, "hello there world", "en"), (3, "hello there world", "en"), (4, "hello there world", None), (None, "another text here", "en")]
    out = spark.createDataFrame([(d, t, lg, "s", len(t or "")) for d, t, lg in rows] + [(100 + i, "the and of with house number" + str(i), "en", "s", 1) for i in range(10)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, out, SF)
    ids = [r["doc_id"] for r in out.collect()]
    assert 1 not in ids and 2 not in ids and 3 not in ids and ids.count(4) == 1


def test_stages_take_columns_of_any_name_and_type(spark):
    """Also maps, which have no order, and the names that stages and operators use themselves."""
    rows = [(i, f"the and of with house number {i % 7} and more", "en") for i in range(20)] + [(None, "a text without an id", "en"), (50, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names = ["score", "lang_pred", "held_out", "_gone", "row", "_row", "_order", "_lang", "_n", "tie", "none", "_no_text", "a b", "_key", "_k0", "source", "class_id", "item"]
    docs = docs.withColumns({n: F.concat(F.lit(n), F.col("doc_id").cast("string")) for n in names}).withColumn("_map", F.create_map(F.lit("k"), F.col("doc_id"))).withColumn("_list", F.array("text"))
    out = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == docs.columns, name
        assert out.schema["_map"].dataType == docs.schema["_map"].dataType
    kept = out.collect()
    assert sorted(r["doc_id"] or 0 for r in kept) == [0, *range(13, 20)]
    assert all(r[n] == (n + str(r["doc_id"]) if r["doc_id"] else None) and (r["doc_id"] is None or r["_map"] == {"k": r["doc_id"]}) for r in kept for n in names)


def test_decisions_reach_rows_without_an_id(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    near = " ".join(f"word{i}" for i in range(100))
    rows = [(None, item), (None, "a clean text of its own"), (None, near + " end"), (5, near)]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.benchmark_stage(spark, corpus_pipeline.near_stage(spark, docs, SF), SF)
    assert sorted(r["text"][:6] for r in left.collect()) == ["a clea", "word0 "]


def test_checkpoints_of_a_run_are_removed(spark, tmp_path):
    folder = spark.sparkContext._jsc.sc().getCheckpointDir()
    before = folder.get() if folder.isDefined() else None
    corpus_pipeline.run(spark, SF, scratch=str(tmp_path)).count()
    assert sorted(p.name for p in tmp_path.iterdir()) == ["decontaminate.parquet"]
    after = spark.sparkContext._jsc.sc().getCheckpointDir()
    assert before is None or after.get().rpartition("/")[0] == before.rpartition("/")[0]
