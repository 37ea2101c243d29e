"""Dedup, joins, roll-ups, set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidweave.functions import rules
from bidweave.operators import dedupe, entities, joins, rollups
from bidweave.plans.registry import Tables, case_sql, query
from bidweave.plans.search import HOST_SQL
from bidweave.sources.registry import inline


@query("DED01", "SELECT min(doc_id) AS doc_id, sha256(text) AS text_hash FROM documents WHERE coalesce(text, '') <> '' GROUP BY text")
def dedup_first_seen(t: Tables):
    # The hash of an empty text is not blank, so texts are looked at before they are hashed; no hash is asked again, which would make it anew.
    keyed = t.documents.where("text <> ''").select("doc_id", F.sha2("text", 256).alias("text_hash"))
    return dedupe.first_seen(keyed, "text_hash", ["doc_id"], blanks=True).select("doc_id", "text_hash")


@query("DED02 SET01", "WITH u AS (SELECT s_nationkey AS key, 0 AS r, s_suppkey AS id FROM supplier UNION ALL SELECT c_nationkey, 1, c_custkey FROM customer UNION ALL SELECT n_nationkey, 2, n_nationkey FROM nation) SELECT key, CAST(arg_min(r, struct_pack(r := r, i := id)) AS INTEGER) AS source_rank, arg_min(id, struct_pack(r := r, i := id)) AS id FROM u GROUP BY key")
def dedup_source_priority(t: Tables):
    sources = [t.supplier.select(F.col("s_nationkey").alias("key"), F.col("s_suppkey").alias("id")), t.customer.select(F.col("c_nationkey").alias("key"), F.col("c_custkey").alias("id")), t.nation.select(F.col("n_nationkey").alias("key"), F.col("n_nationkey").cast("bigint").alias("id"))]
    return dedupe.by_source(sources, "key", ["id"], blanks=True).select("key", "source_rank", "id")


@query("DED04", "WITH f AS (SELECT user_id, event_type, min(event_id) AS e FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type, ',' ORDER BY e) AS types FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY e) AS rn FROM f) WHERE rn <= 20 GROUP BY 1")
def ordered_distinct(t: Tables):
    firsts = t.events.groupBy("user_id", "event_type").agg(F.min("event_id").alias("e"))
    lists = firsts.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("e", "event_type"))).alias("l"))
    return lists.select("user_id", F.array_join(dedupe.distinct_in_order(F.transform("l", lambda x: x["event_type"])), ",").alias("types"))


@query("DED05 SNK05", "SELECT user_id, arg_min(event_id, struct_pack(v := value, e := -event_id)) AS event_id, min(value) AS value FROM events GROUP BY 1")
def last_writer(t: Tables):
    return dedupe.last_writer(t.events.select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("JOI01 PRJ04 AGG02", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def parent_child_counts(t: Tables):
    return rollups.counted(t.customer.select("c_custkey"), t.orders, "c_custkey", "o_custkey")


ALIASES = [(10, ["NATION_1", "nation_2 "]), (20, ["nation_2", "Nation_3"]), (30, ["NATION_5"])]


@query("JOI04 SRC36", "SELECT n_nationkey, CAST(CASE lower(n_name) WHEN 'nation_1' THEN 10 WHEN 'nation_3' THEN 20 WHEN 'nation_2' THEN 20 WHEN 'nation_5' THEN 30 END AS BIGINT) AS client FROM nation")
def alias_join(t: Tables):
    dim = t.spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).cast("bigint").alias("client"), F.array(*[F.lit(x) for x in a]).alias("aliases")) for k, a in ALIASES])).alias("r")).select("r.*")
    return joins.by_alias(t.nation.select("n_nationkey", "n_name"), "n_name", dim, "aliases", "client").select("n_nationkey", "client")


@query("JOI04 DED03", """WITH t AS (SELECT doc_id, trim(regexp_replace(lower(array_to_string(string_split(text, ' ')[1:4], ' ')), '[^a-z ]', '', 'g')) AS name FROM documents),
n AS (SELECT name, count(*) AS n FROM t WHERE name <> '' GROUP BY 1),
r AS (SELECT a.name, arg_min(b.name, struct_pack(n := -b.n, s := b.name)) AS entity, count(*) AS n_similar FROM n a JOIN n b ON 100 * levenshtein(a.name, b.name) <= 15 * greatest(length(a.name), length(b.name)) GROUP BY 1)
SELECT doc_id, t.name, entity, n_similar FROM t LEFT JOIN r ON t.name = r.name""")
def resolved_names(t: Tables):
    """The opening words of each document as its name, resolved to the commonest similar one."""
    opening = F.substring_index("text", " ", 4)
    return entities.resolved(t.documents.select("doc_id", F.trim(F.regexp_replace(F.lower(opening), "[^a-z ]", "")).alias("name")), "name")


@query("JOI04 SRC36", """WITH k AS (SELECT p_partkey, p_name AS name FROM part), a AS (SELECT row_number() OVER (ORDER BY name) AS client, name || 's' AS alias FROM (SELECT DISTINCT p_name AS name FROM part)),
m AS (SELECT k.name, min(struct_pack(e := levenshtein(k.name, alias), c := client)) AS best FROM (SELECT DISTINCT name FROM k) k JOIN a ON 100 * levenshtein(k.name, alias) <= 15 * greatest(length(k.name), length(alias)) GROUP BY 1)
SELECT p_partkey, CAST(best.c AS INTEGER) AS client FROM k LEFT JOIN m ON k.name = m.name""")
def similar_alias_join(t: Tables):
    """Parts to clients whose aliases are spelled a little differently: here the parts' own names in the plural."""
    names = t.part.select(F.col("p_name").alias("name")).distinct()
    clients = names.select(F.row_number().over(Window.orderBy("name")).alias("client"), F.array(F.concat("name", F.lit("s"))).alias("aliases"))
    return entities.by_similar_alias(t.part.select("p_partkey", "p_name"), "p_name", clients, "aliases", "client").select("p_partkey", "client")


@query("JOI05 SNK07", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_insert(t: Tables):
    return joins.without_existing(t.customer.select("c_custkey"), t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


PLACES = [(1, "thing", "er", "p1"), (2, "and", "on", "p2"), (3, "", "que", "p3"), (4, "zzzz", "de", "p4")]


@query("JOI06", """SELECT doc_id, CASE WHEN contains(x, 'thing') THEN 'p1' WHEN contains(x, 'and') THEN 'p2' WHEN contains(x, 'de') THEN 'p4' WHEN contains(x, 'que') THEN 'p3' WHEN contains(x, 'on') THEN 'p2' WHEN contains(x, 'er') THEN 'p1' END AS place_id FROM (SELECT doc_id, lower(text) AS x FROM documents)""")
def text_contains_join(t: Tables):
    places = inline(t.spark, "ordinal int, city string, state string, id string", PLACES)
    return joins.contained_place(t.documents.select("doc_id", F.lower("text").alias("x")), "x", places).select("doc_id", "place_id")


@query("JOI07", f"SELECT page_id, CASE WHEN contains(h, 'ththly') THEN 'B' WHEN contains(h, 'example.org') THEN 'C' WHEN contains(h, 'blog') THEN 'D' ELSE 'State Portal' END AS portal FROM (SELECT page_id, {HOST_SQL} AS h FROM pages)")
def first_match_dimension(t: Tables):
    from bidweave.functions.text import url_host

    portals = inline(t.spark, "ordinal int, domain string, name string", [(1, "ththly", "B"), (2, "example.org", "C"), (3, "blog", "D")])
    return joins.first_match(t.pages.select("page_id", url_host("url").alias("h")), "h", portals, "State Portal").select("page_id", "portal")


@query("JOI06", """WITH places AS (SELECT item_id, lower(array_to_string(string_split_regex(trim(text), '\\s+')[1:3], ' ')) AS opening, lower(string_split_regex(trim(text), '\\s+')[4]) AS fourth FROM benchmark),
hits AS (SELECT doc_id, min(CASE WHEN opening <> '' AND contains(lower(text), opening) THEN item_id END) AS a, max(CASE WHEN fourth <> '' AND contains(lower(text), fourth) THEN item_id END) AS b FROM documents, places GROUP BY doc_id)
SELECT doc_id, coalesce(a, b) AS place_id FROM hits""")
def mention_join(t: Tables):
    """The dimension is a table too: the first three words of each benchmark item stand for a city of several words, the fourth for a state."""
    w = F.split(F.trim(F.col("text")), r"\s+")
    places = t.benchmark.select(F.col("item_id").alias("id"), F.col("item_id").alias("ordinal"), F.array_join(F.slice(w, 1, 3), " ").alias("city"), F.get(w, F.lit(3)).alias("state"))
    return joins.contained_place(t.documents.select("doc_id", F.lower("text").alias("x")), "x", places).select("doc_id", "place_id")


@query("JOI07", f"""WITH h AS (SELECT page_id, {HOST_SQL} AS h FROM pages), portals AS (SELECT split_part(h, '.', 1) AS domain, min(page_id) AS ordinal FROM h GROUP BY 1)
SELECT page_id, coalesce((SELECT arg_min(domain, ordinal) FROM portals WHERE domain <> '' AND contains(h, domain)), 'State Portal') AS portal FROM h""")
def portal_index(t: Tables):
    """A portal for each first label of a host; a host takes the oldest one whose name it contains."""
    from bidweave.functions.text import url_host

    pages = t.pages.select("page_id", url_host("url").alias("h"))
    portals = pages.groupBy(F.split_part("h", F.lit("."), F.lit(1)).alias("domain")).agg(F.min("page_id").alias("ordinal")).withColumn("name", F.col("domain"))
    return joins.first_match(pages, "h", portals, "State Portal").select("page_id", "portal")


@query("JOI11", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'Finished' WHEN 'O' THEN 'Open' ELSE 'Other' END AS label FROM orders")
def label_lookup(t: Tables):
    labels = inline(t.spark, "code string, label string", [("F", "Finished"), ("O", "Open")])
    return joins.labelled(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", labels, "Other").select("o_orderkey", "label")


@query("JOI02 JOI09 JOI12", """SELECT c_custkey, o.orders, n.nation FROM customer LEFT JOIN (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS orders FROM orders GROUP BY 1) o ON o_custkey = c_custkey
LEFT JOIN (SELECT n_nationkey, n_name AS nation FROM nation) n ON n_nationkey = c_nationkey""")
def children_bundle(t: Tables):
    rows = rollups.bundled(t.customer.select("c_custkey", "c_nationkey"), "c_custkey", [("orders", t.orders, "o_custkey", F.col("o_orderkey"))])
    rows = rows.join(F.broadcast(t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))), "c_nationkey", "left")
    return rows.select("c_custkey", F.when(F.col("orders").isNotNull(), F.array_join(F.transform("orders", lambda x: x.cast("string")), ",")).alias("orders"), "nation")


@query("AGG03 TOP01", "SELECT coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown') AS label, count(*) AS n, CAST(row_number() OVER (ORDER BY count(*) DESC, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown')) AS INTEGER) AS pos FROM customer GROUP BY 1 ORDER BY pos LIMIT 12")
def group_topn(t: Tables):
    return rollups.top_counts(t.customer.select(F.nullif("c_mktsegment", F.lit("BUILDING")).alias("s")), rollups.labelled("s"), 12)


@query("AGG04 AGG05", "SELECT event_type, count(*) FILTER (value > 50) AS high, count(*) FILTER (value <= 50) AS low, CAST(sum(CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id END) AS BIGINT) AS total FROM events GROUP BY 1")
def conditional_counts(t: Tables):
    as_text = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("event_id").cast("string"))
    return t.events.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.count_if(F.col("value") <= 50).alias("low"), F.sum(F.coalesce(as_text.try_cast("bigint"), F.lit(0))).alias("total"))


@query("AGG06", "SELECT l_suppkey, l_returnflag, l_linestatus, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS amount, CAST(row_number() OVER (ORDER BY sum(CAST(l_extendedprice AS DECIMAL(18,2))) DESC, l_suppkey, l_returnflag, l_linestatus) AS INTEGER) AS pos FROM lineitem GROUP BY 1, 2, 3 ORDER BY pos LIMIT 15")
def multi_key_topk(t: Tables):
    return rollups.top_sums(t.lineitem, ["l_suppkey", "l_returnflag", "l_linestatus"], "l_extendedprice", 15).withColumn("amount", F.col("amount").cast("double"))


PARTY = "CASE WHEN {c} THEN 'Republican' WHEN {d} THEN 'Democrat' ELSE 'Other / Bipartisan' END"
PAYEE = "['rnc fund', 'dnc fund', 'civic group', 'gop house'][CAST(c_custkey % 4 AS INTEGER) + 1]"


@query("AGG07 CLS15", f"WITH x AS (SELECT {case_sql(PAYEE, rules.PARTY, 'Other / Bipartisan')} AS label, sum(CAST(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS DECIMAL(18,2))) AS a FROM customer GROUP BY 1) SELECT label, CAST(a AS DOUBLE) AS amount, CAST(floor(CAST(a AS DOUBLE) / (SELECT CAST(sum(a) AS DOUBLE) FROM x) * 100 + 0.5) AS INTEGER) AS pct FROM x WHERE a > 0")
def percent_split(t: Tables):
    payee = F.element_at(F.array(*[F.lit(x) for x in ("rnc fund", "dnc fund", "civic group", "gop house")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    return rollups.percent_split(t.customer, rules.classify(payee, rules.PARTY, "Other / Bipartisan"), F.when(F.col("c_acctbal") < 0, 0.0).otherwise(F.col("c_acctbal"))).withColumn("amount", F.col("amount").cast("double"))


@query("AGG08", "SELECT CAST(sum(a) AS DOUBLE) AS amount, count(*) AS periods FROM (SELECT year(o_orderdate) AS y, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS a FROM orders GROUP BY 1 ORDER BY 1 DESC LIMIT 4)")
def recent_periods(t: Tables):
    return rollups.recent(t.orders.withColumn("y", F.year("o_orderdate")), "y", "o_totalprice", 4).withColumn("amount", F.col("amount").cast("double"))


@query("AGG09", "WITH f AS (SELECT r_name, n_name, count(*) AS n, count(*) FILTER (s_acctbal > 0) AS p FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2) SELECT r_name, CAST(sum(n) AS BIGINT) AS total, CAST(sum(p) AS BIGINT) AS flagged, string_agg(n_name || '=' || n, ',' ORDER BY n_name) AS categories FROM f GROUP BY 1")
def nested_rollup(t: Tables):
    rows = t.supplier.join(F.broadcast(t.nation), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    out = rollups.nested_counts(rows, "r_name", "n_name", F.col("s_acctbal") > 0)
    return out.withColumn("categories", F.array_join(F.transform("categories", lambda c: F.concat(c["category"], F.lit("="), c["count"].cast("string"))), ","))


@query("AGG10", """WITH d AS (SELECT c_nationkey, CASE c_custkey % 5 WHEN 0 THEN 'unknown' WHEN 1 THEN NULL WHEN 2 THEN 'contracting' ELSE CASE WHEN c_nationkey % 2 = 0 THEN 'growing' ELSE 'stable' END END AS d FROM customer),
a AS (SELECT c_nationkey, count(*) AS children, count(*) FILTER (d IS NULL OR d <> 'unknown') AS k, count(*) FILTER (d = 'growing') AS g, count(*) FILTER (d = 'contracting') AS c FROM d GROUP BY 1)
SELECT c_nationkey, CASE WHEN k = 0 THEN 'unknown' WHEN g / k >= 0.5 THEN 'growing' WHEN c / k >= 0.5 THEN 'contracting' ELSE 'stable' END AS trend, children FROM a""")
def majority_ratio(t: Tables):
    k = F.col("c_custkey") % 5
    d = F.when(k == 0, "unknown").when(k == 1, F.lit(None)).when(k == 2, "contracting").otherwise(F.when(F.col("c_nationkey") % 2 == 0, "growing").otherwise("stable"))
    return rollups.majority_trend(t.customer.select("c_nationkey", d.alias("d")), "c_nationkey", "d")


@query("AGG11", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, (SELECT string_agg(p, ',' ORDER BY p) FROM (SELECT DISTINCT o_orderpriority AS p FROM orders i WHERE i.o_orderstatus = o.o_orderstatus)) AS priorities FROM orders o GROUP BY 1")
def distinct_counts(t: Tables):
    return t.orders.groupBy("o_orderstatus").agg(F.count_distinct("o_custkey").alias("customers"), F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))


@query("AGG12", """WITH x AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'Unknown' ELSE 'Q' || quarter(o_orderdate) || ' 20' || right(CAST(year(o_orderdate) AS VARCHAR), 2) END AS period, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS v, count(*) AS n FROM orders GROUP BY 1)
SELECT period, floor(CAST(v AS DOUBLE) / 1000000 * 100 + 0.5) / 100 AS value, n, CAST(row_number() OVER (ORDER BY period = 'Unknown', period) AS INTEGER) AS pos FROM x""")
def quarter_timeline(t: Tables):
    from pyspark.sql import Window

    from bidweave.functions.text import period

    said = F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.concat(F.date_format("o_orderdate", "MMM d"), F.lit(", 20"), F.date_format("o_orderdate", "yy")))
    sums = t.orders.groupBy(period(said).alias("period")).agg(F.sum(rollups.cents("o_totalprice")).alias("v"), F.count("*").alias("n"))
    # a few dozen periods: ordering them takes one small partition
    pos = F.row_number().over(Window.orderBy(F.col("period") == "Unknown", "period"))
    return sums.select("period", (F.floor(F.col("v").cast("double") / 1_000_000 * 100 + 0.5) / 100).alias("value"), "n", pos.alias("pos"))


@query("AGG13", "WITH c AS (SELECT date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders WHERE o_orderdate < TIMESTAMP '2001-05-01' GROUP BY 1), s AS (SELECT unnest(generate_series(TIMESTAMP '2001-03-01', TIMESTAMP '2001-08-01', INTERVAL 1 MONTH)) AS m) SELECT CAST(coalesce(c.m, s.m) AS DATE) AS month, coalesce(n, 0) AS n FROM c FULL JOIN s ON c.m = s.m")
def monthly_spine(t: Tables):
    return rollups.month_spine(t.orders.where(F.col("o_orderdate") < F.lit("2001-05-01").cast("timestamp_ntz")), F.trunc("o_orderdate", "month"), "2001-08-15")


@query("AGG14", "SELECT CAST(year(o_orderdate) AS VARCHAR) AS year, count(*) FILTER (o_orderstatus = 'O') AS active, count(*) FILTER (o_orderstatus = 'F') AS closed FROM orders GROUP BY 1")
def year_status_pivot(t: Tables):
    filed = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.groupBy(F.substring(filed, 1, 4).alias("year")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("active"), F.count_if(F.col("o_orderstatus") == "F").alias("closed"))


@query("AGG15", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, CAST(sum(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END) AS BIGINT) AS sized FROM events GROUP BY 1")
def json_sum(t: Tables):
    arrays = F.when(F.col("event_id") % 2 == 0, '["a","b"]').otherwise("oops")
    return t.events.groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").try_cast("bigint")).alias("total"), F.sum(F.coalesce(F.array_size(F.from_json(arrays, "array<string>")), F.lit(0))).cast("bigint").alias("sized"))


@query("AGG17 AGG18 SRT07", """WITH g AS (SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1) SELECT r_name, nations, CAST(row_number() OVER (ORDER BY CASE WHEN r_name = 'EUROPE' THEN 0 ELSE 1 END, r_name) AS INTEGER) AS pos FROM g""")
def grouped_lists(t: Tables):
    from pyspark.sql import Window

    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    lists = rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("nations"))
    return lists.withColumn("pos", F.row_number().over(Window.orderBy(F.when(F.col("r_name") == "EUROPE", 0).otherwise(1), "r_name")))


@query("AGG21", "SELECT event_type, sum(CASE WHEN event_id % 4 = 0 THEN 0 ELSE 1 END)::BIGINT AS total FROM events GROUP BY 1")
def failure_as_zero(t: Tables):
    settled = F.when(F.col("event_id") % 4 == 0, "timeout").otherwise("1").try_cast("bigint")
    return t.events.groupBy("event_type").agg(F.sum(F.coalesce(settled, F.lit(0))).alias("total"))


@query("SET02 SET03 SET04", """SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'user,' ELSE '' END || 'q1,q2' AS queries, CASE WHEN c_custkey % 3 = 0 THEN 'a' ELSE 'a,b,x' END AS toggled FROM customer WHERE c_custkey IN (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def key_difference(t: Tables):
    left = t.customer.select("c_custkey").subtract(t.orders.where("o_orderstatus = 'F'").select("o_custkey"))
    own = F.when(F.col("c_custkey") % 2 == 0, F.array(F.lit("user"))).otherwise(F.array().cast("array<string>"))
    chosen = F.array(F.lit("a"), F.lit("b"))
    return left.select("c_custkey", F.array_join(F.concat(own, F.array(F.lit("q1"), F.lit("q2"))), ",").alias("queries"), F.array_join(F.when(F.col("c_custkey") % 3 == 0, F.array_remove(chosen, "b")).otherwise(F.array_append(chosen, F.lit("x"))), ",").alias("toggled"))


@query("PRJ07", "SELECT n_nationkey, CASE n_regionkey WHEN 0 THEN 'u' || n_nationkey WHEN 1 THEN 'v' || n_name END AS url FROM nation")
def column_by_key(t: Tables):
    wide = t.nation.select("n_nationkey", "n_regionkey", F.concat(F.lit("u"), F.col("n_nationkey").cast("string")).alias("u0"), F.concat(F.lit("v"), F.col("n_name")).alias("u1"))
    return wide.select("n_nationkey", F.when(F.col("n_regionkey") == 0, F.col("u0")).when(F.col("n_regionkey") == 1, F.col("u1")).alias("url"))
