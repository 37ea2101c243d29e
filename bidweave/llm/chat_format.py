"""Chat formatting of turns with typed content parts.

A visitor turns the parts of a turn (text, image, audio, document) into one string:
texts are escaped, other parts become placeholders in order, and each placeholder's
reference and expanded token count is recorded. Turns are marked as

    <|turn:ROLE|>\\nCONTENT<|end|>\\n

Inside roles and texts a backslash is written \\s and a bar \\p. So a bar in the output
always belongs to a mark or a placeholder, and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_OPEN, TURN_MID, TURN_END = "<|turn:", "|>\n", "<|end|>\n"

#: A content part; what a type has no use for stays null.
PART_TYPE = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"

#: Pixels along the side of an image patch, tokens of a second of audio, of a page of a document.
IMAGE_PATCH, AUDIO_TOKENS, PAGE_TOKENS = 14, 25, 600


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\s")), F.lit("|"), F.lit("\\p"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\p"), F.lit("|")), F.lit("\\s"), F.lit("\\"))


def text_part(text: Column) -> Column:
    """A one-element array of parts that holds a text; null counts as the empty text."""
    none = F.lit(None)
    return F.array(
        F.struct(
            F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), none.cast("string").alias("ref"), none.cast("int").alias("width"), none.cast("int").alias("height"), none.cast("double").alias("seconds"), none.cast("int").alias("pages")
        )
    )


def _visit_text(part: Column) -> Column:
    """What a part adds to the content."""
    return (
        F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
        .when(part["type"].isin("image", "audio", "document"), F.concat(F.lit("<|"), part["type"], F.lit("|>")))
        .otherwise(F.lit("<|part|>"))
    )


def _visit_tokens(part: Column) -> Column:
    """Tokens that a placeholder stands for once expanded."""
    side = lambda c: F.ceil(F.coalesce(c, F.lit(0)) / IMAGE_PATCH)
    return (
        F.when(part["type"] == "image", side(part["width"]) * side(part["height"]))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * AUDIO_TOKENS))
        .when(part["type"] == "document", F.coalesce(part["pages"], F.lit(0)).cast("bigint") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("bigint")
    )


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", parts_col: str | None = None, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: its id, n_turns, formatted, loss_spans, attachments, expanded_tokens.

    ``parts_col`` names an array of PART_TYPE; without it the text column is the only part.
    Null text, null parts and null role count as empty. Turns with the same number are
    ordered by role, then content; repeated rows are turns of their own. A part of unknown
    type becomes <|part|>. loss_spans holds start and end (code points, end exclusive) of
    each turn of ``loss_role``; attachments holds (turn, type, ref, tokens) in the order of
    the placeholders. A null conversation id is a conversation. An empty table gives none.

    A conversation becomes one string, so its turns meet in one row by definition; all
    else (offsets, counts) comes from windows over slim columns, without appending to arrays.
    """
    parts = F.coalesce(F.col(parts_col), F.array().cast(f"array<{PART_TYPE}>")) if parts_col else text_part(F.col(text_col))
    seen = turns.select(F.col(conv_col).alias("_conv"), F.col(turn_col).alias("_turn"), F.coalesce(F.col(role_col), F.lit("")).alias("_role"), parts.alias("_parts"))
    content = F.concat(F.lit(""), F.array_join(F.transform("_parts", _visit_text), ""))
    made = seen.select(
        "_conv",
        "_turn",
        "_role",
        F.concat(F.lit(TURN_OPEN), escape(F.col("_role")), F.lit(TURN_MID)).alias("_head"),
        content.alias("_content"),
        F.transform(F.filter("_parts", lambda p: ~(p["type"] == "text")), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), _visit_tokens(p).alias("tokens"))).alias("_att"),
    )
    order = Window.partitionBy("_conv").orderBy("_turn", "_role", "_content")
    head, body = F.length("_head").cast("bigint"), F.length("_content").cast("bigint")
    placed = made.withColumns(
        {
            "_no": F.row_number().over(order),
            "_start": F.sum(head + body + len(TURN_END)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - body - len(TURN_END),
        }
    )
    row = F.struct("_no", "_turn", "_role", "_head", "_content", "_start", (F.col("_start") + body).alias("_end"), "_att")
    joined = placed.groupBy("_conv").agg(F.array_sort(F.collect_list(row)).alias("_rows"))
    attachments = F.flatten(F.transform("_rows", lambda r: F.transform(r["_att"], lambda a: F.struct(r["_turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    return joined.select(
        F.col("_conv").alias(conv_col),
        F.size("_rows").cast("bigint").alias("n_turns"),
        F.array_join(F.transform("_rows", lambda r: F.concat(r["_head"], r["_content"], F.lit(TURN_END))), "").alias("formatted"),
        F.transform(F.filter("_rows", lambda r: r["_role"] == loss_role), lambda r: F.struct(r["_start"].alias("start"), r["_end"].alias("end"))).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("bigint"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation as array<struct<role, content>>, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|end\|>\n"), lambda p: p != "")
    role = lambda p: F.substring_index(F.substr(p, F.lit(len(TURN_OPEN) + 1)), "|>", 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescape(role(p)).alias("role"),
            unescape(F.substr(p, F.length(role(p)) + F.lit(len(TURN_OPEN) + len(TURN_MID) + 1))).alias("content"),
        ),
    )


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
