"""From raw documents to token ids: five stages, each one operator of ``bidweave.llm``.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.llm import byte_bpe, decontaminate, exact_dedup, language_id, ngram_join
from bidweave.llm.common import checkpoints_in, keyed, new_folder, read, remove, without


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; null and letterless texts go. The language found replaces none of the columns."""
    rows = keyed(docs)
    seen = language_id.predict(rows, language_id.fit(docs), keep=["row"])
    return seen.where(F.col("lang_pred") != language_id.UNKNOWN).select("row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest id stays."""
    return exact_dedup.distinct_documents(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id stays."""
    rows = keyed(docs)
    classes = ngram_join.near_duplicates(rows)
    return without(rows, classes.where("doc_id <> class_id").select("doc_id"))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    rows = keyed(docs)
    hits = decontaminate.contaminated(rows, read(spark, sf_dir, "benchmark"))
    return without(rows, hits.select("doc_id"))


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with digests of the ids and of the decoded bytes."""
    return byte_bpe.encode_documents(docs, keep_ids=True)


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("decontaminate", benchmark_stage),
    ("byte_bpe", encode_stage),
]

#: Language ID and byte-level BPE can't be written in SQL; the tests hold a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, scratch: str | None = None) -> DataFrame:
    """All stages over the documents of a folder. What a stage leaves is written as Parquet to a folder of this run inside
    ``scratch`` (by default the shared folder of checkpoints); the checkpoints of its operators, and the table before it, are removed then.

    The result reads the last of these tables: remove its folder when the result isn't needed any more."""
    folder = new_folder(spark, scratch)
    docs, last = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with checkpoints_in(spark, f"{folder}/checkpoints"):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}.parquet")
        docs = spark.read.parquet(f"{folder}/{name}.parquet")
        if last:
            remove(spark, last)
        last = f"{folder}/{name}.parquet"
    return STAGES[-1][1](spark, docs, sf_dir)
