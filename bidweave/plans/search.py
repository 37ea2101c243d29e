"""Scans, filters, gates and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidweave.functions.dates import moment, not_expired, stamp
from bidweave.functions.text import blank_to_null, has_any, joined
from bidweave.operators import filters as f
from bidweave.operators import merge, pages, text_index
from bidweave.plans.registry import Tables, any_sql, query
from bidweave.schemas import DOMAINS, ordinal
from bidweave.storage import scratch_folder

PAGE_SQL = """
SELECT p_partkey, p_name, CAST(row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS INTEGER) AS pos, (SELECT count(*) FROM part WHERE {w}) AS total
FROM part WHERE {w} ORDER BY p_retailprice DESC, p_partkey LIMIT {n} OFFSET {o}
"""


@query("FLT01 FLT04 SRT01 AGG01", PAGE_SQL.format(w="(p_name ILIKE '%e%' OR p_brand ILIKE '%e%') AND p_size > 10", n=50, o=50))
def search_page(t: Tables):
    hits = f.matching(t.part, f.any_ilike("e", "p_name", "p_brand"), f.equals("p_type", "all"), F.col("p_size") > 10)
    return f.page(hits, [F.desc("p_retailprice"), F.asc("p_partkey")], number=2).select("p_partkey", "p_name", "pos", "total")


@query("FLT01 FLT06", r"""SELECT p_partkey, p_name, p_brand FROM part WHERE p_name ILIKE '%d b\_t%' ESCAPE '\' OR p_brand ILIKE '%d b\_t%' ESCAPE '\' OR p_name ILIKE '%d _olt%' OR p_brand ILIKE '%d _olt%' OR p_name ILIKE '%brand#2%' OR p_brand ILIKE '%brand#2%'""")
def indexed_search(t: Tables):
    """Searches through the stored trigrams of names and brands; each row comes once, whatever terms find it."""
    index = text_index.build(t.part.select("p_partkey", "p_name", "p_brand"), "p_partkey", ["p_name", "p_brand"], scratch_folder(t.spark))
    found = [text_index.search(t.spark, index, term) for term in ("d b\\_t", "d _olt", "Brand#2")]
    return reduce(DataFrame.unionByName, found).distinct()


@query("FLT01", "SELECT doc_id, n_chars FROM documents WHERE text ILIKE '%license, version%'")
def indexed_documents(t: Tables):
    index = text_index.build(t.documents.select("doc_id", "text", "n_chars"), "doc_id", ["text"], scratch_folder(t.spark))
    return text_index.search(t.spark, index, "license, version").select("doc_id", "n_chars")


DEEP_ORDER = [("o_totalprice", True), ("o_orderkey", False)]


@query("FLT01 SRT01 SRT02", "SELECT o_orderkey, o_totalprice, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS pos, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 1200")
def deep_page(t: Tables):
    """A page far down, from the range of the order that it lies in; all rows are put into ranges first."""
    stored = pages.store(t.orders.select("o_orderkey", "o_totalprice"), DEEP_ORDER, f"{scratch_folder(t.spark)}/orders")
    return pages.page_at(t.spark, stored, number=25)


@query("FLT01 SRT01 SRT02", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 150000 OR o_totalprice = 150000 AND o_orderkey > 0 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def page_after_row(t: Tables):
    return pages.page_after(t.orders.select("o_orderkey", "o_totalprice"), DEEP_ORDER, [150000.0, 0])


@query("AGG01 SRT02", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM part WHERE p_name ILIKE '%a%'")
def search_page_total(t: Tables):
    return f.matching(t.part, f.any_ilike("a", "p_name")).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 50.0).alias("pages"))


@query("FLT03 FLT04", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F'")
def optional_filters(t: Tables):
    return f.matching(t.orders, f.equals("o_orderstatus", "F"), f.equals("o_orderpriority", "all"), f.equals("o_orderpriority", None)).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("FLT05", "SELECT o_orderkey, nullif(o_orderstatus, 'O') AS agency, nullif(o_orderpriority, '1-URGENT') AS deadline FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL OR nullif(o_orderpriority, '1-URGENT') IS NULL OR o_orderstatus = 'P' ORDER BY o_orderkey LIMIT 100")
def missing_or_unknown(t: Tables):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("O")).alias("agency"), F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("deadline"))
    return rows.where(F.col("agency").isNull() | F.col("deadline").isNull() | (F.col("agency") == "P")).orderBy("o_orderkey").limit(100)


@query("FLT09", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 5000")
def soft_filter_hit(t: Tables):
    return f.soft_filter(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_acctbal") > 5000).drop("c_acctbal")


@query("FLT09", "SELECT c_custkey, c_mktsegment FROM customer")
def soft_filter_miss(t: Tables):
    return f.soft_filter(t.customer.select("c_custkey", "c_mktsegment", "c_acctbal"), F.col("c_acctbal") > 1e9).drop("c_acctbal")


@query("FLT10 SRC19 SRC27", "SELECT s_suppkey AS id, 'a' AS src FROM supplier WHERE s_acctbal > 1e8 UNION ALL SELECT c_custkey, 'b' FROM customer WHERE (SELECT count(*) FROM supplier WHERE s_acctbal > 1e8) < 5 UNION ALL SELECT s_suppkey, 'c' FROM supplier")
def fallback_source(t: Tables):
    few = t.supplier.where("s_acctbal > 1e8").select(F.col("s_suppkey").alias("id"), F.lit("a").alias("src"))
    many = t.supplier.select(F.col("s_suppkey").alias("id"), F.lit("c").alias("src"))
    more = t.customer.select(F.col("c_custkey").alias("id"), F.lit("b").alias("src"))
    return f.with_fallback(few, more, 5).unionByName(f.with_fallback(many, more, 5))


BLOCK = ["example.net", "blog.ththly.example.org", "ththe.example.com"]
HOST_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)), 'www\.', '')"


@query("FLT07 STR10", f"SELECT page_id, h AS host FROM (SELECT page_id, {HOST_SQL} AS h FROM pages) WHERE NOT (" + " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in BLOCK) + ")")
def blocked_domains(t: Tables):
    from bidweave.functions.text import url_host

    return t.pages.where(~f.blocked("url", BLOCK)).select("page_id", url_host("url").alias("host"))


KEEP, REJECT = ["license", "token", "password", "thing"], ["copyright", "zzz", "rights reserved"]


@query("FLT08", f"SELECT doc_id FROM (SELECT doc_id, lower(text) AS x FROM documents) WHERE NOT {any_sql('x', REJECT)} AND {any_sql('x', KEEP)}")
def keyword_gate(t: Tables):
    return t.documents.where(f.gate(joined("text"), KEEP, REJECT)).select("doc_id")


@query("FLT11 DAT03", "SELECT o_orderkey, nullif(o_orderdate, TIMESTAMP '1996-01-01') AS deadline FROM orders WHERE nullif(o_orderdate, TIMESTAMP '1996-01-01') IS NULL OR o_orderdate >= TIMESTAMP '1998-06-01' - INTERVAL 1 DAY")
def deadline_grace(t: Tables):
    rows = t.orders.select("o_orderkey", F.nullif("o_orderdate", F.lit("1996-01-01").cast("timestamp_ntz")).alias("deadline"))
    return rows.where(not_expired(F.col("deadline"), F.lit("1998-06-01").cast("timestamp_ntz")))


@query("SNK04", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '1998-01-01' THEN 'archived' ELSE o_orderstatus END AS status FROM orders")
def archive_expired(t: Tables):
    due = F.coalesce((F.col("o_orderstatus") == "O") & (stamp("o_orderdate") < moment("1998-01-01")), F.lit(False))
    return t.orders.select("o_orderkey", F.when(due, "archived").otherwise(F.col("o_orderstatus")).alias("status"))


@query("FLT12", "SELECT d.doc_id, CAST(coalesce(quality, 0) * 50 AS INTEGER) AS score FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(quality, 0) * 50 >= 45")
def threshold_default(t: Tables):
    score = F.coalesce("quality", F.lit(0)) * 50
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").where(score >= 45).select("doc_id", score.alias("score"))


@query("SRC01 SRC02 SRC03 SRT03", "SELECT c_custkey, c_name FROM customer WHERE c_custkey = 42")
def point_lookup(t: Tables):
    return t.customer.where(F.col("c_custkey") == 42).select("c_custkey", "c_name").orderBy("c_name")


@query("FLT02 FLT06", "SELECT p_partkey, p_type ILIKE 'econom_' AS pattern, contains(lower(p_name), '_') AS literal, p_brand ILIKE 'brand#1_' AS brand FROM part")
def wildcard_vs_literal(t: Tables):
    return t.part.select("p_partkey", F.ilike("p_type", F.lit("econom_")).alias("pattern"), f.holds("_", "p_name").alias("literal"), F.ilike("p_brand", F.lit("brand#1_")).alias("brand"))


OVERSIGHT = r"(?i)\b(license|thing|token|rights)\b"
PRIORITY = ["ththth", "ofthat", "thing", "licens"]


@query("FLT13 FLT14 FLT15", rf"SELECT doc_id, regexp_matches(text, '{OVERSIGHT}') OR contains(source, 'src1') AS word_hit, regexp_matches(text, '(?i)licens|waiver') AS title_hit, {any_sql('lower(text)', PRIORITY)} AS priority FROM documents")
def regex_gates(t: Tables):
    text = F.col("text")
    return t.documents.select("doc_id", (text.rlike(OVERSIGHT) | F.contains(F.col("source"), F.lit("src1"))).alias("word_hit"), text.rlike("(?i)licens|waiver").alias("title_hit"), has_any(F.lower(text), PRIORITY).alias("priority"))


@query("FLT16 PRJ01 STR01", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 'pursue' WHEN p_size % 3 = 1 THEN 'wait' ELSE 'monitor' END AS tag, TRY_CAST(CASE WHEN p_size > 25 THEN CAST(p_size AS VARCHAR) ELSE 'n/a' END AS DOUBLE) AS amount, nullif(trim(CASE WHEN p_size > 10 THEN ' ' || p_brand || ' ' ELSE '  ' END), '') AS name, lower(substring(p_name, 1, 5)) AS short FROM part")
def domain_default(t: Tables):
    raw = F.when(F.col("p_size") % 3 == 0, "pursue").when(F.col("p_size") % 3 == 1, "wait").otherwise("later")
    return t.part.select(
        "p_partkey",
        f.in_domain(raw, DOMAINS["action_tag"], "monitor").alias("tag"),
        F.when(F.col("p_size") > 25, F.col("p_size").cast("string")).otherwise("n/a").try_cast("double").alias("amount"),
        blank_to_null(F.when(F.col("p_size") > 10, F.concat(F.lit(" "), F.col("p_brand"), F.lit(" "))).otherwise("  ")).alias("name"),
        F.lower(F.substring("p_name", 1, 5)).alias("short"),
    )


@query("SRT02 SRT06", "SELECT event_id, CAST(row_number() OVER (ORDER BY value, ts, event_id) AS INTEGER) AS pos, (SELECT count(*) FROM events) AS total FROM events ORDER BY value, ts, event_id LIMIT 200 OFFSET 200")
def page_clamped(t: Tables):
    return f.page(t.events.select("event_id", "value", "ts"), [F.asc_nulls_last("value"), F.asc_nulls_last("ts"), F.asc("event_id")], number=2, size=5000).select("event_id", "pos", "total")


@query("TOP02 TOP03", "SELECT doc_id, CAST(row_number() OVER (ORDER BY doc_id) AS INTEGER) AS pos FROM documents WHERE length(text) < 800 ORDER BY doc_id LIMIT 10")
def first_n_matches(t: Tables):
    return f.first_rows(t.documents.select("doc_id", "text"), F.length("text") < 800, [F.asc("doc_id")], 10).select("doc_id", "pos")


@query("FLT17", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def membership(t: Tables):
    return t.customer.where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).join(t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("SRT04", "SELECT o_orderkey, o_custkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY nullif(o_orderstatus, 'O') ASC NULLS LAST, nullif(o_orderpriority, '5-LOW') ASC NULLS LAST, o_orderkey) AS INTEGER) AS pos FROM orders")
def nulls_order(t: Tables):
    """A parent's children in order, nulls last."""
    rows = t.orders.select("o_orderkey", "o_custkey", F.nullif("o_orderstatus", F.lit("O")).alias("a"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("b"))
    return f.placed(rows, ["o_custkey"], [F.asc_nulls_last("a"), F.asc_nulls_last("b"), F.asc("o_orderkey")]).select("o_orderkey", "o_custkey", "pos")


PRIORITIES = ["2-HIGH", "1-URGENT", "5-LOW", "3-MEDIUM", "4-NOT SPECIFIED"]


@query("SRT05 SRT07", "SELECT o_orderkey, CAST(k AS INTEGER) AS ordinal, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY k, o_orderkey) AS INTEGER) AS pos FROM (SELECT *, list_position(['2-HIGH', '1-URGENT', '5-LOW', '3-MEDIUM', '4-NOT SPECIFIED'], o_orderpriority) AS k FROM orders)")
def enum_order(t: Tables):
    """A parent's children in the order in which an enum declares its values."""
    rows = t.orders.select("o_orderkey", "o_custkey", ordinal(F.col("o_orderpriority"), PRIORITIES).cast("int").alias("ordinal"))
    return f.placed(rows, ["o_custkey"], [F.asc("ordinal"), F.asc("o_orderkey")]).select("o_orderkey", "ordinal", "pos")


@query("SNK09", "SELECT o_orderkey, o_orderstatus FROM orders WHERE NOT (o_orderstatus = 'P' AND o_orderpriority = '5-LOW')")
def delete_rows(t: Tables):
    return merge.deleted(t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority"), (F.col("o_orderstatus") == "P") & (F.col("o_orderpriority") == "5-LOW")).drop("o_orderpriority")
