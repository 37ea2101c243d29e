"""The trie of conversation prefixes, named by prefix doubling.

Each distinct turn gets a dense number. Blocks of a power of two turns, aligned at multiples of their length, are named in
rounds: the name of a block is the dense number of the pair of names of its halves. A prefix of d turns is a row of such
blocks, one for each binary digit of d, and the same rounds compose its name, lowest digit first. So after log2(longest) rounds of joins
over slim rows, two prefixes have one name if, and only if, their turns are equal, and a node is a group of prefixes.

Numbers go on from round to round, so a name says its sequence whatever its length is. Sums over subtrees need no descent from
depth to depth: each node is owned by its smallest member, whose own nodes are the last ones of its path, so a subtree's sum is that of its members' sums from its depth on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.llm.common import Scratch, numbered, prepare, text_or_empty
from bidweave.llm.components import loose

#: Name of the root, the prefix without turns.
ROOT = -1
#: Rows of a conversation, or ids of a node, that one group gathers at most.
CHUNK_BITS = 12
ID_BITS = 33  # of monotonically_increasing_id, for the place inside a task


def _dense(rows: DataFrame, keys: list[str], before: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """The distinct keys with a ``name`` from ``before`` on, without gaps; and the first number that is free."""
    spark = rows.sparkSession
    found = scratch.keep(rows.select(*keys).distinct().select("*", F.monotonically_increasing_id().alias("_at")))
    task = F.shiftright("_at", ID_BITS)
    offsets = []
    for r in found.groupBy(task.alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect():  # a row for each task
        offsets.append((r["task"], before))
        before += r["n"]
    table = F.broadcast(spark.createDataFrame(offsets, "_task bigint, _offset bigint"))
    named = found.join(table, task == F.col("_task")).select(*keys, (F.col("_offset") + F.col("_at").bitwiseAND(F.lit((1 << ID_BITS) - 1))).alias("name"))
    return named, before


def turn_rows(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, key, chars) for each turn: a digest of role and text, which count as empty if null, and the text's code points."""
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    key = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = turns.where(F.col(id_col).isNotNull())
    return rows.select(F.col(id_col).cast("bigint").alias("conv"), F.col(turn_col).alias("turn"), role.alias("role"), key.alias("key"), F.length(text).cast("bigint").alias("chars"))


def placed_turns(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, key, chars) and (conv, n): turns in order, those without a number first; role, then digest break ties."""
    table, stretches = numbered(rows, "conv", ["turn", "role", "key"], scratch)
    placed = table.join(stretches, ["_pid", "conv"]).select("conv", (F.col("_at") - F.col("_first") + F.col("_before")).alias("pos"), "key", "chars")
    return placed, stretches.groupBy("conv").agg(F.sum("_n").alias("n"))


def grafted(rows: DataFrame, scratch: Scratch, width: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin like another: c takes the first h turns of c - c % ``width``, then its own turns after its first h, h = crc32(c) % ``most``.

    Takes rows of ``turn_rows``; returns (conv, pos, key, chars) and (conv, n), n being 0 where nothing is left."""
    table, stretches = numbered(rows, "conv", ["turn", "role", "key"], scratch)
    stretches = scratch.keep(stretches)
    h = F.pmod(F.crc32(F.encode(F.col("conv").cast("string"), "UTF-8")), F.lit(most))
    convs = stretches.groupBy("conv").agg(F.sum("_n").alias("own")).select("conv", "own", h.alias("h"), (F.col("conv") - F.col("conv") % width).alias("base"))
    bases = convs.where(F.col("conv") % width == 0).select(F.col("conv").alias("base"), F.col("own").alias("there"))
    plans = scratch.keep(convs.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("there", F.lit(0)))))
    # Only slim stretches are joined by conversation; turns meet theirs by task and conversation.
    placed = table.join(stretches.join(plans, "conv"), ["_pid", "conv"]).withColumn("pos", F.col("_at") - F.col("_first") + F.col("_before"))
    own = placed.where(F.col("pos") >= F.col("h")).select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "key", "chars")
    heads = placed.where((F.col("conv") % width == 0) & (F.col("pos") < most - 1)).select(F.col("conv").alias("base"), "pos", "key", "chars")
    copies = heads.join(plans.select("base", "conv", "head"), "base").where(F.col("pos") < F.col("head")).select("conv", "pos", "key", "chars")
    members = plans.select("conv", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return own.unionByName(copies), members


def _bit(d: str | Column, k: int) -> Column:
    return F.shiftright(d, k).bitwiseAND(F.lit(1)) == 1


def prefix_names(placed: DataFrame, longest: int, scratch: Scratch) -> DataFrame:
    """(conv, d, name, chars) for each prefix of d > 0 turns, chars being those of its last turn. ``placed``: (conv, pos, key, chars).

    Round k names the blocks of 2^k turns, and takes the prefixes' digit k - 1: a prefix that has it goes on with the pair of the block
    there and the name of what its lower digits stand for. Prefixes shorter than 2^k are done then."""
    placed = scratch.keep(placed)
    names, free = _dense(placed, ["key"], 0, scratch)
    turns = scratch.keep(placed.join(names, "key").select("conv", "pos", "name", "chars"))
    none = F.lit(None).cast("bigint")
    blocks = turns.select("conv", F.col("pos").alias("at"), "name")
    prefixes = turns.select("conv", (F.col("pos") + 1).alias("d"), none.alias("name"), "chars")
    done = [prefixes.where("false")]
    for k in range(1, longest.bit_length() + 1):
        before = blocks.select(loose("conv").alias("conv"), "at", F.col("name").alias("block"))
        with_block = prefixes.where(_bit("d", k - 1)).select(loose("conv").alias("conv"), (F.shiftright("d", k - 1) - 1).alias("at"), "d", "name", "chars").join(before, ["conv", "at"])
        # Kinds: 0 halves of a block, 1 parts of a prefix, 2 a prefix whose name is l already.
        rows = with_block.select(F.when(F.col("name").isNull(), 2).otherwise(1).alias("kind"), "conv", F.col("d").alias("at"), F.col("block").alias("l"), F.col("name").alias("r"), "chars")
        rows = rows.unionByName(prefixes.where(~_bit("d", k - 1)).select(F.lit(2).alias("kind"), "conv", F.col("d").alias("at"), F.col("name").alias("l"), none.alias("r"), "chars"))
        if 1 << k <= longest:
            sides = [F.max(F.when(F.col("at") % 2 == side, F.col("name"))).alias(c) for side, c in enumerate("lr")]
            halves = blocks.groupBy("conv", F.shiftright("at", 1).alias("half")).agg(*sides).where("l IS NOT NULL AND r IS NOT NULL")
            rows = rows.unionByName(halves.select(F.lit(0).alias("kind"), "conv", F.col("half").alias("at"), "l", "r", none.alias("chars")))
        rows = scratch.keep(rows)
        names, free = _dense(rows.where("kind < 2"), ["l", "r"], free, scratch)
        named = rows.where("kind < 2").join(names, ["l", "r"])
        blocks = named.where("kind = 0").select("conv", "at", "name")
        whole = named.where("kind = 1").select("conv", F.col("at").alias("d"), "name", "chars").unionByName(rows.where("kind = 2").select("conv", F.col("at").alias("d"), F.col("l").alias("name"), "chars"))
        done.append(whole.where(F.col("d") < 1 << k))
        prefixes = whole.where(F.col("d") >= 1 << k)
    return scratch.keep(reduce(DataFrame.unionByName, done))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the parts of each name, which follow one another in order, joined by commas. Nothing but the state of one digest is kept."""
    name, digest = None, hashlib.sha256()
    for batch in batches:
        names, digests = [], []
        for n, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if n != name:
                if name is not None:
                    names.append(name)
                    digests.append(digest.hexdigest())
                name, digest = n, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(digests, pa.string())], ["name", "ends_sha256"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([digest.hexdigest()])], ["name", "ends_sha256"])


def ends_digests(ends: DataFrame, scratch: Scratch) -> DataFrame:
    """(name, ends_sha256) of (name, conv): ids in numerical order, comma-joined.

    Ids are put in order and joined in parts of bounded size, wherever they are; a digest can only be made in order, so the parts of one
    node then pass one task, a few thousand ids a row, which keeps none of them."""
    prepare(ends.sparkSession)
    table, stretches = numbered(ends, "name", ["conv"], scratch)
    part = F.shiftright(F.col("_at") - F.col("_first") + F.col("_before"), CHUNK_BITS)
    parts = table.join(stretches, ["_pid", "name"]).groupBy("name", part.alias("part")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",").alias("ids"))
    return parts.repartition("name").sortWithinPartitions("name", "part").select("name", "ids").mapInArrow(_hashed, "name bigint, ends_sha256 string")


def _later_sums(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(conv, d, name) with the sums of the columns over each conversation's rows from d on: inside chunks of d, then over chunks."""
    rows = rows.withColumn("_chunk", F.shiftright("d", CHUNK_BITS))
    inside = Window.partitionBy("conv", "_chunk").orderBy(F.desc("d")).rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumns({c: F.sum(c).over(inside) for c in columns})
    totals = rows.groupBy("conv", "_chunk").agg(*[F.sum(c).alias(f"_{c}") for c in columns])
    after = Window.partitionBy("conv").orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    later = totals.withColumns({f"_{c}": F.coalesce(F.sum(f"_{c}").over(after), F.lit(0)) for c in columns}).where(" OR ".join(f"_{c} <> 0" for c in columns))
    return near.join(later, ["conv", "_chunk"], "left").select("conv", "d", "name", *[(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in columns])


def prefix_trie(placed: DataFrame, members: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """The nodes of the trie of all prefixes of conversations: conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``placed`` has (conv, pos, key, chars), positions from 0 without gaps, ``members`` (conv, n) for every conversation, n being its turns, 0 too.
    The root has depth 0 and every conversation as a member; without conversations there is none. A node is told by conv_id and depth.
    n_leaves counts the nodes without children in a node's subtree, itself included; saved_tokens sums (n_convs - 1) times the code points of
    the last text over it; ends_sha256 is of the ids that end at the node, of the empty string if none does.

    A turn, an opening or a whole conversation may be shared by any share of all, and one conversation may hold any share of the turns: groups are
    counted partially before the shuffle, and joins of hot names have one row of them on one side, so that adaptive execution splits the other.
    Repeated conversations are members of the same nodes. The tables of the run lie in the shared folder and go when the session ends."""
    scratch = scratch or Scratch(placed.sparkSession)
    members = scratch.keep(members)
    longest = members.agg(F.max("n")).first()[0] or 0
    named = prefix_names(placed, longest, scratch)
    rows = named.unionByName(members.select("conv", F.lit(0).cast("bigint").alias("d"), F.lit(ROOT).cast("bigint").alias("name"), F.lit(0).cast("bigint").alias("chars")))
    nodes = scratch.keep(rows.groupBy("name", "d").agg(F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.max("chars").alias("chars")))
    above = rows.select(F.col("conv").alias("owner"), (F.col("d") + 1).alias("d"), F.col("name").alias("parent"))
    nodes = scratch.keep(nodes.join(above, ["owner", "d"], "left"))
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    nodes = scratch.keep(nodes.join(children, "name", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("bigint"))))

    worth = nodes.select(F.col("owner").alias("conv"), "d", (F.col("n_children") == 0).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    sums = ["n_leaves", "saved_tokens"]
    valued = rows.select("conv", "d", "name").join(worth, ["conv", "d"], "left").select("conv", "d", "name", *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in sums])
    subtree = _later_sums(valued, sums).groupBy("name").agg(*[F.sum(c).alias(c) for c in sums])

    ends = rows.join(members.select("conv", F.col("n").alias("d")), ["conv", "d"]).select("name", "conv")
    digests = ends_digests(ends, scratch)
    parents = nodes.select(F.col("name").alias("parent"), F.col("owner").alias("parent_conv_id"))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    found = nodes.join(subtree, "name").join(digests, "name", "left").join(parents, "parent", "left")
    return found.select(F.col("owner").alias("conv_id"), F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", *sums, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))


def conversation_trie(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", graft: bool = False) -> DataFrame:
    """``prefix_trie`` of a table of turns; with ``graft``, of conversations that begin like the first of their hundred (``grafted``).

    Turns go by their number, null first, then role, then a digest. Null roles and texts count as empty; rows without a conversation are left out.
    Texts of any length count whole; other columns are left out, so their names can't clash. An empty table gives no nodes."""
    scratch = Scratch(turns.sparkSession)
    rows = turn_rows(turns, id_col, turn_col, role_col, text_col)
    placed, members = (grafted if graft else placed_turns)(rows, scratch)
    return prefix_trie(placed, members, scratch)
