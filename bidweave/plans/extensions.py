"""Queries beyond the reference's own operators: Spark's joins, grouping sets, frames, set operations and time windows.

They are kept apart so that none is taken for behaviour of the reference.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidweave.operators.joins import as_of, in_range
from bidweave.plans.registry import Tables, query
from bidweave.streaming.refresh import windowed_counts


@query("extension", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def ext_cube(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("qty"), F.count("*").alias("n"))


@query("extension", "SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ROLLUP (c_nationkey, c_mktsegment)")
def ext_rollup(t: Tables):
    return t.customer.rollup("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("extension", "SELECT o_orderkey, lag(o_orderkey) OVER w AS before, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS last_three, CAST(ntile(4) OVER w AS INTEGER) AS quarter FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def ext_frames(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t.orders.select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).over(w.rowsBetween(-2, 0)).cast("double").alias("last_three"), F.ntile(4).over(w).alias("quarter"))


@query("extension", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def ext_intersect(t: Tables):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("extension", "SELECT e.event_id, p.event_id AS last_purchase FROM events e ASOF LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, ts ORDER BY event_id DESC) AS rn FROM events WHERE event_type = 'purchase') WHERE rn = 1) p ON e.user_id = p.user_id AND e.ts >= p.ts")
def ext_as_of_join(t: Tables):
    events = t.events.select("event_id", "user_id", "ts")
    bought = t.events.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("last_purchase"))
    return as_of(events, bought, "user_id", "ts", "last_purchase").select("event_id", "last_purchase")


@query("extension", "SELECT o_orderkey, p_partkey FROM orders JOIN (SELECT p_partkey, p_retailprice * 100 AS lo, p_retailprice * 100 + 50 AS hi FROM part) ON o_totalprice >= lo AND o_totalprice < hi")
def ext_range_join(t: Tables):
    ranges = t.part.select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 50).alias("hi"))
    return in_range(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice", ranges, "lo", "hi", width=50.0).select("o_orderkey", "p_partkey")


@query("extension", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def ext_tumbling_windows(t: Tables):
    return windowed_counts(t.events, "ts", "event_type", "6 hours").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query("extension", """WITH m AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS first FROM events), s AS (SELECT *, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sess FROM m)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, sess""")
def ext_sessions(t: Tables):
    return t.events.groupBy("user_id", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n")).select("user_id", F.col("s.start").cast("timestamp_ntz").alias("session_start"), "n")


@query("extension")
def ext_approximate(t: Tables):
    """Approximate distinct counts and percentiles; no SQL counterpart gives the same approximations."""
    return t.lineitem.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))
