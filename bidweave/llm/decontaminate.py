"""Benchmark decontamination: size-partitioned MinHash containment search, then exact containment.

Items are short and documents may be very long, so the likeness of two signatures would
say little. Instead an item's signature, its s smallest shingle hashes, is looked up among all shingle hashes of a document
(containment MinHash). Items are partitioned by size class, and s follows from the class so that no hit can be lost: a
document that holds a share t of the q shingles misses q - ceil(t q) of them at most, so
among any q - ceil(t q) + 1 it holds one. Documents too short for a class take no part in it.
The shingles of documents are never shuffled: signatures go to them, in passes of bounded size, and
only hits move. Candidates are then verified on the words themselves.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import cut_lineage, words

#: Signature hashes that one pass over the documents looks up (8 bytes each, some 30 in a hash table).
PASS_HASHES = 1_000_000
#: A table is broadcast only if it was counted to have no more bytes than this.
BROADCAST_BYTES = 64 << 20
#: What a row of ids takes, with room to spare.
ROW_BYTES = 64


def _grams(tokens: Column, k: Column | int) -> Column:
    """Distinct runs of k words, as strings; none where there are fewer words."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.when(F.size(tokens) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(tokens) - k + 1), lambda i: F.array_join(F.slice(tokens, i, k), " ")))).otherwise(F.array().cast("array<string>"))


def _gram_hashes(hashed: Column, k: int) -> Column:
    """Hashes of the runs of k words, from hashes of the words; repeats are kept."""
    run = lambda i: F.xxhash64(F.lit(k), *[F.get(hashed, i + j) for j in range(k)])
    return F.when(F.size(hashed) >= k, F.transform(F.sequence(F.lit(0), F.size(hashed) - k), run)).otherwise(F.array().cast("array<bigint>"))


def _word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def item_shingles(items: DataFrame, id_col: str, text_col: str, shingle: int, threshold: float) -> DataFrame:
    """Per item: its id, k, distinct shingles, and the signature of hashes that candidates must meet."""
    tokens = items.select(F.col(id_col).alias("item"), words(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    shaped = tokens.select("item", "w", F.least(F.size("w"), F.lit(shingle)).alias("k")).select("item", "k", "w", _grams(F.col("w"), F.col("k")).alias("grams"))
    hashes = None
    for k in range(1, shingle + 1):
        case = F.array_distinct(_gram_hashes(_word_hashes(F.col("w")), k))
        hashes = F.when(F.col("k") == k, case) if hashes is None else hashes.when(F.col("k") == k, case)
    q = F.size("grams")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(q.cast("double"))))  # the size class: (upper / 2, upper]
    missed = F.floor(upper * (1 - threshold) + 1e-9).cast("int")
    return shaped.withColumn("h", F.array_sort(hashes)).select("item", "k", "grams", F.slice("h", F.lit(1), F.least(missed + 1, F.size("h"))).alias("signature"))


def _maybe_broadcast(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BROADCAST_BYTES else df


def _hits(docs: DataFrame, signature: DataFrame, sizes: list[int]) -> DataFrame:
    """(doc, size, h): signature hashes that documents hold, with the documents' numbers of words."""
    tokens = docs.select("doc", words(F.col("text")).alias("w")).select("doc", F.size("w").alias("size"), _word_hashes(F.col("w")).alias("hw"))
    hashes = F.flatten(F.array(*[_gram_hashes(F.col("hw"), k) for k in sizes])) if sizes else F.array().cast("array<bigint>")
    exploded = tokens.select("doc", "size", F.explode(hashes).alias("h"))
    wanted = cut_lineage(signature.select("h").distinct())
    passes = max(1, math.ceil(wanted.count() / PASS_HASHES))
    found = [exploded.join(F.broadcast(wanted.where(F.pmod("h", F.lit(passes)) == i)), "h", "left_semi") for i in range(passes)]
    return cut_lineage(reduce(DataFrame.unionByName, found).select("doc", "size", "h").distinct())


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """Pairs of document and benchmark item of whose word shingles the document holds ``threshold`` or more.

    Returns one row per pair: the two id columns, n_shingles (distinct ones of the item), n_found,
    containment. Items of fewer than ``shingle`` words are one shingle of all their words;
    items and documents without words take part in no pair, nor do nulls. Words are runs of letters
    and digits in lower case. Rows that repeat a document id count as one document: the
    best row stands for it. Repeated items are one. Empty tables give no rows. Other columns
    are left out.

    More than PASS_HASHES signature hashes are looked up in several passes over the documents. Hits, candidates
    and items are measured and broadcast up to BROADCAST_BYTES; beyond that they are joined by shuffling, with the same result.
    """
    parts = cut_lineage(item_shingles(items, item_id_col, item_text_col, shingle, threshold).dropDuplicates(["item", "grams"]))
    sizes = [r["k"] for r in parts.select("k").distinct().orderBy("k").collect()]  # 1 to ``shingle``: bounded
    # The least number of words of a document that holds enough shingles of the item.
    least = F.ceil(F.size("grams") * threshold - 1e-9).cast("int") + F.col("k") - 1
    signature = parts.select("item", least.alias("least"), F.explode("signature").alias("h"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))

    hits = _hits(texts, signature, sizes)
    by_hash = hits.join(_maybe_broadcast(signature, signature.count() * ROW_BYTES), "h").where("size >= least")
    pairs = cut_lineage(by_hash.select("doc", "item").distinct())

    wanted = pairs.select("doc").distinct()
    hit = texts.join(_maybe_broadcast(wanted, wanted.count() * ROW_BYTES), texts["doc"].eqNullSafe(wanted["doc"]), "left_semi")
    both = hit.join(_maybe_broadcast(pairs, pairs.count() * ROW_BYTES).withColumnRenamed("doc", "doc2"), F.col("doc").eqNullSafe(F.col("doc2"))).drop("doc2")
    size = parts.agg(F.sum(F.aggregate("grams", F.lit(ROW_BYTES), lambda n, g: n + F.octet_length(g) + 16))).first()[0] or 0
    both = both.join(_maybe_broadcast(parts.select("item", "k", "grams"), size), "item")
    # The words are a column of their own, so that they aren't split again for each shingle.
    split = both.select("doc", "item", "k", "grams", words(F.col("text")).alias("w"))
    checked = split.select("doc", "item", F.size("grams").alias("q"), F.size(F.array_intersect("grams", _grams(F.col("w"), F.col("k")))).alias("n"))
    best = checked.groupBy("doc", "item").agg(F.max(F.struct((F.col("n") / F.col("q")).alias("c"), "n", "q")).alias("b"))
    return best.where(F.col("b.c") >= threshold - 1e-12).select(F.col("doc").alias(id_col), F.col("item").alias(item_id_col if item_id_col != id_col else "item_id"), F.col("b.q").cast("bigint").alias("n_shingles"), F.col("b.n").cast("bigint").alias("n_found"), F.col("b.c").alias("containment"))
