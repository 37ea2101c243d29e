"""Exact de-duplication by 128-bit content hash, with bytes compared inside the groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.llm.common import text_or_empty


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """Marks, among rows of equal text, the one with the smallest (or ``keep="largest"``) id.

    Returns one row per input row: the id column, keep_id, group_size, kept, text_sha256.
    Null counts as the empty text. Rows that repeat an id and its text share one fate. A
    null id is kept only where its group has no other id. An empty table gives none;
    other columns are left out, so their names can't clash.

    The 128-bit hash leads the grouping key and the text follows it, so equal hashes are
    told apart by their bytes; copies meet before the shuffle, however many there are.
    Rows then find their group by both hashes over slim rows, a join that adaptive
    execution splits where one group is large.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError("keep is 'smallest' or 'largest'")
    text = text_or_empty(text_col)
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    hashed = rows.withColumn("_h", F.md5("_text"))
    groups = (
        hashed.groupBy("_h", "_text")
        .agg((F.min if keep == "smallest" else F.max)("_id").alias("keep_id"), F.count("*").alias("group_size"))
        .select("_h", F.sha2("_text", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    slim = hashed.select("_id", "_h", F.sha2("_text", 256).alias("text_sha256"))
    return slim.join(groups, ["_h", "text_sha256"]).select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``docs``, with all columns of whatever types, of which one stays for each text: that with the smallest (or largest) id.

    Null counts as the empty text and stays null only if the kept row has it so. Of rows that repeat an id and text,
    null texts come first, then a hash of the other columns (all but maps, which have no order) decides. A null id is the smallest."""
    rest = [f for f in docs.schema.fields if f.name not in (id_col, text_col) and "map<" not in f.dataType.simpleString()]
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in rest]) if rest else F.lit(0)
    rows = docs.select(
        F.struct(F.col(id_col).alias("id"), F.col(text_col).isNull().alias("none"), tie.alias("tie")).alias("_order"),
        F.struct(*[(F.col(f"`{c}`") if c != text_col else F.col(text_col).isNull()).alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("_row"),
        text_or_empty(text_col).alias("_text"),
    )
    best = rows.groupBy(F.md5("_text").alias("_h"), "_text").agg((F.min_by if keep == "smallest" else F.max_by)("_row", "_order").alias("_row"))
    part = lambda i, c: F.col("_row")[f"c{i}"] if c != text_col else F.when(~F.col("_row")[f"c{i}"], F.col("_text"))
    return best.select(*[part(i, c).alias(c) for i, c in enumerate(docs.columns)])
