"""Writes as pure functions over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidweave.operators import bucketed, merge, rollups
from bidweave.plans.registry import Tables, query
from bidweave.sources.registry import inline
from bidweave.storage import scratch_folder


@query("SNK01 SNK02 SNK14", "SELECT c_custkey, trim(CASE WHEN c_custkey % 2 = 0 THEN ' ' || c_name ELSE c_name END) AS name, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_mktsegment END AS notes, CASE WHEN c_custkey % 5 = 0 THEN 'regional' ELSE 'national' END AS tier FROM customer")
def normalise_insert(t: Tables):
    k = F.col("c_custkey")
    rows = t.customer.select("c_custkey", F.when(k % 2 == 0, F.concat(F.lit(" "), "c_name")).otherwise(F.col("c_name")).alias("name"), F.when(k % 3 == 0, "  ").otherwise(F.col("c_mktsegment")).alias("notes"), F.when(k % 5 == 0, "").otherwise("national").alias("tier"))
    return merge.prepared(rows, ["name", "notes", "tier"], {"tier": "regional"})


@query("SNK03", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'new' ELSE c_name END AS c_name, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def patch_update(t: Tables):
    state = t.customer.select("c_custkey", "c_name", "c_mktsegment")
    k = F.col("c_custkey")
    patch = state.where((k % 4 == 0) | (k % 6 == 0)).select("c_custkey", F.lit("new").alias("c_name"), (k % 4 == 0).alias("has_c_name"), F.lit("").alias("c_mktsegment"), (k % 6 == 0).alias("has_c_mktsegment"))
    return merge.patched(state, patch, "c_custkey")


UPSERT_SQL = """SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 1 THEN CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'changed' END WHEN c_custkey % 3 = 0 AND c_custkey % 5 <> 0 THEN 'changed' ELSE c_name END AS title,
CASE WHEN c_custkey % 2 = 0 THEN 'pursue' ELSE 'monitor' END AS tag FROM customer"""


@query("SNK05 SNK06", UPSERT_SQL)
def keyed_upsert(t: Tables):
    """State: even keys. Change: odd keys (new) and multiples of three; a null title keeps the old one, a tag stays."""
    k = F.col("c_custkey")
    state = t.customer.where(k % 2 == 0).select(k.alias("id"), F.col("c_name").alias("title"), F.lit("pursue").alias("tag"))
    change = t.customer.where((k % 2 == 1) | (k % 3 == 0)).select(k.alias("id"), F.when(k % 5 == 0, F.lit(None)).otherwise("changed").alias("title"), F.lit("monitor").alias("tag"))
    return merge.upserted(state, change, "id", keep=["tag"])


@query("SNK05 SNK06", UPSERT_SQL)
def bucketed_upsert(t: Tables):
    """The same change, on a stored state of which it rewrites the buckets that it touches."""
    k = F.col("c_custkey")
    rows = t.customer.where(k % 2 == 0).select(k.alias("id"), F.col("c_name").alias("title"), F.lit("pursue").alias("tag"))
    state = bucketed.BucketedState.create(rows, scratch_folder(t.spark) + "/state", ["id"], 16)
    state.upsert(t.customer.where((k % 2 == 1) | (k % 3 == 0)).select(k.alias("id"), F.when(k % 5 == 0, F.lit(None)).otherwise("changed").alias("title"), F.lit("monitor").alias("tag")), keep=["tag"])
    return state.read(t.spark)


@query("SNK08 SNK13", "SELECT event_type AS key, arg_max(user_id, event_id) AS value, 'b=2,' || event_type || '=9' AS times FROM events GROUP BY 1")
def kv_upsert(t: Tables):
    last = merge.last_values(t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("value"), "event_id"), "key", "event_id").drop("event_id")
    old = F.create_map(F.lit("b"), F.lit("2"), F.col("key"), F.lit("1"))
    fresh = F.array_sort(F.map_entries(merge.set_key(old, F.col("key"), F.lit("9"))), lambda a, b: F.when(a["value"] < b["value"], -1).otherwise(1))
    return last.select("key", "value", F.array_join(F.transform(fresh, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("times"))


REPLACE_SQL = "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '1-URGENT') UNION ALL SELECT -o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0"


@query("SNK10", REPLACE_SQL)
def partition_overwrite(t: Tables):
    state = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    fresh = state.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    touched = inline(t.spark, "o_orderstatus string, o_orderpriority string", [("P", "1-URGENT")])
    return merge.replaced_partitions(state, fresh, ["o_orderstatus", "o_orderpriority"], touched).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SNK10", REPLACE_SQL)
def bucketed_refresh(t: Tables):
    """The same replacement on a stored state: only the bucket of the replaced keys is written."""
    rows = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority")
    state = bucketed.BucketedState.create(rows, scratch_folder(t.spark) + "/state", ["o_orderstatus", "o_orderpriority"], 16)
    fresh = rows.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND o_orderkey % 2 = 0").withColumn("o_orderkey", -F.col("o_orderkey"))
    state.replace(fresh, rows.where("o_orderstatus = 'P' AND o_orderpriority = '1-URGENT'"))
    return state.read(t.spark)


@query("SNK11 SNK09", "SELECT 'order' AS kind, o_orderkey AS key FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 'line', l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')")
def cascade_delete(t: Tables):
    orders, lines = merge.cascaded(t.orders, t.lineitem, t.orders.where("o_orderstatus = 'P'"), "o_orderkey", "l_orderkey")
    return orders.select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("key")).unionByName(lines.select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("key")))


@query("SNK12", "SELECT c_custkey, coalesce(n, -1) AS n, coalesce(last, 'stale') AS last FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderpriority) AS last FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) ON o_custkey = c_custkey")
def rollup_writeback(t: Tables):
    parents = t.customer.select("c_custkey", F.lit(-1).cast("bigint").alias("n"), F.lit("stale").alias("last"))
    rolled = t.orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderpriority").alias("last"))
    return merge.written_back(parents, rolled, "c_custkey", ["n", "last"])


@query("SNK12 AGG01", """SELECT c_custkey, count(parent) AS n FROM customer LEFT JOIN (SELECT CASE o_orderkey % 10 WHEN 0 THEN NULL WHEN 1 THEN o_custkey + 1 ELSE o_custkey END AS parent FROM orders
UNION ALL SELECT o_custkey FROM orders WHERE o_orderkey % 25 = 0) ON parent = c_custkey GROUP BY c_custkey""")
def counts_after_changes(t: Tables):
    """Stored counts of a customer's orders after deletes, moves and inserts: only the buckets of customers whose orders changed are written."""
    k = F.col("o_orderkey")
    counted = rollups.counted(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey").toDF("c_custkey", "n")
    state = bucketed.BucketedState.create(counted, scratch_folder(t.spark) + "/state", ["c_custkey"], 16)
    changed = t.orders.where(k % 10 < 2).select(F.col("o_custkey").alias("before"), F.when(k % 10 == 1, F.col("o_custkey") + 1).alias("after"))
    added = t.orders.where(k % 25 == 0).select(F.lit(None).cast("bigint").alias("before"), F.col("o_custkey").alias("after"))
    deltas = merge.signed_deltas(changed.unionByName(added), "before", "after")
    state.apply(deltas.withColumnRenamed("parent", "c_custkey"), lambda stored, d: merge.counts_maintained(stored, d.withColumnRenamed("c_custkey", "parent"), "c_custkey", "n"))
    return state.read(t.spark)


@query("SNK15", """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'found' END ELSE o_orderstatus END AS deadline, CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 'City' ELSE o_orderpriority END AS agency,
CAST(CASE WHEN o_orderkey % 6 = 0 THEN 1 ELSE 0 END + CASE WHEN o_orderpriority = '5-LOW' AND o_orderkey % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS filled FROM orders""")
def backfill_missing(t: Tables):
    k = F.col("o_orderkey")
    state = t.orders.select("o_orderkey", F.when(k % 2 != 0, F.col("o_orderstatus")).alias("deadline"), F.col("o_orderpriority").alias("agency"))
    found = t.orders.where(k % 3 == 0).select("o_orderkey", F.lit("found").alias("deadline"), F.lit("City").alias("agency"))
    return merge.backfilled(state, found, "o_orderkey", ["deadline", "agency"], {"agency": "5-LOW"})


@query("AGG19", "SELECT count(*) FILTER (s = 0) AS created, count(*) FILTER (s = 1) AS updated, count(*) FILTER (s >= 2) AS skipped, count(*) AS fetched FROM (SELECT page_id % 4 AS s FROM pages)")
def run_stats(t: Tables):
    s = F.col("page_id") % 4
    tagged = t.pages.select(F.when(s == 0, "created").when(s == 1, "updated").otherwise("skipped").alias("outcome"))
    return rollups.outcomes(tagged.unionByName(tagged.select(F.lit("fetched").alias("outcome"))), "outcome", ["created", "updated", "skipped", "fetched"])
