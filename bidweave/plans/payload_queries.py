"""Payloads of searches and of campaign finance, portals, templates, uploads, and work done elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.operators import neighbours
from bidweave.plans.registry import Tables, query
from bidweave.sources import finance, portals, registry, remote, searches, templates
from bidweave.storage import scratch_folder
from bidweave.streaming import tasks


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(quote, row)) + ")" for row in rows) + ")"


@query("SRC20 SRC21 DED01", """WITH r AS (
  SELECT c_custkey AS k, 0 AS pos, c_name AS title, 'http://a/' || c_custkey % 200 AS link FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 1, '', 'http://n/' || c_custkey % 50 FROM customer WHERE c_custkey % 3 = 1
), f AS (SELECT *, row_number() OVER (PARTITION BY link ORDER BY k % 5, k, pos) AS rn FROM r)
SELECT link, CAST(k % 5 AS INTEGER) AS query_idx, k AS c_custkey, CAST(pos AS INTEGER) AS pos, title, '' AS snippet FROM f WHERE rn = 1""")
def search_payloads(t: Tables):
    """Results under ``organic`` or else ``news``, the first of each link over all queries."""
    k = F.col("c_custkey")
    organic = F.array(F.struct(F.col("c_name").alias("title"), F.concat(F.lit("http://a/"), (k % 200).cast("string")).alias("link")))
    news = F.array(F.struct(F.concat(F.lit("news "), "c_name").alias("title"), F.lit("").alias("link")), F.struct(F.lit(None).cast("string").alias("title"), F.concat(F.lit("http://n/"), (k % 50).cast("string")).alias("link")))
    payload = F.to_json(F.struct(F.when(k % 3 == 0, organic).alias("organic"), F.when(k % 3 != 2, news).alias("news"), F.lit(1).alias("credits")))
    rows = searches.web_results(t.customer.select((k % 5).cast("int").alias("query_idx"), k, payload.alias("payload")), "payload", ["query_idx", "c_custkey"])
    return searches.unique_links(rows, ["query_idx", "c_custkey", "pos"]).select("link", "query_idx", "c_custkey", "pos", "title", "snippet")


@query("SRC22 SRC23", """SELECT s_suppkey, s_name AS title, CASE WHEN s_suppkey % 2 = 0 THEN 'first second' ELSE 'body ' || s_suppkey END AS highlights,
CASE WHEN s_suppkey % 4 = 0 THEN 'page ' || s_suppkey ELSE 'short' END AS content, CASE WHEN s_suppkey % 3 = 0 THEN 0.0 ELSE 0.5 END::DOUBLE AS score FROM supplier""")
def content_payloads(t: Tables):
    """Neural results with highlights, research results with content, and pages that were fetched whole."""
    k = F.col("s_suppkey")
    url, none = F.concat(F.lit("http://s/"), k.cast("string")), F.lit(None)
    wrap = lambda *items: F.to_json(F.struct(F.array(*items).alias("results")))
    neural = wrap(F.struct(F.col("s_name").alias("title"), url.alias("url"), F.when(k % 2 == 0, F.array(F.lit("first"), F.lit("second"))).alias("highlights"), F.concat(F.lit("body "), k.cast("string")).alias("text")))
    research = wrap(F.struct(url.alias("url"), F.lit("short").alias("content"), F.when(k % 3 != 0, 0.5).alias("score")))
    fetched = wrap(F.struct(url.alias("url"), F.concat(F.lit("page "), k.cast("string")).alias("raw_content")), F.struct(F.lit("").alias("url"), F.lit("lost").alias("raw_content")), F.struct(url.alias("url"), none.cast("string").alias("raw_content")))
    deep = searches.research_results(t.supplier.select(k, research.alias("p")), "p", ["s_suppkey"])
    whole = searches.with_pages(deep, searches.extracted_pages(t.supplier.where(k % 4 == 0).select(fetched.alias("p")), "p"))
    found = searches.neural_results(t.supplier.select(k, neural.alias("p")), "p", ["s_suppkey"]).select("s_suppkey", "title", F.col("content").alias("highlights"))
    return found.join(whole.select("s_suppkey", "content", "score"), "s_suppkey")


@query("SRC24 STR13", """WITH q AS (SELECT *, n_nationkey % 6 AS i FROM nation WHERE n_nationkey % 6 < 4),
h AS (SELECT 'you' AS p, n_nationkey, n_name AS title, CASE WHEN n_nationkey % 2 = 0 THEN 'one two' ELSE 'plain' END AS description, 'http://you/' || n_nationkey AS url FROM q
  UNION ALL SELECT 'langsearch', n_nationkey, n_name, 'snippet', 'http://lang/' || n_nationkey FROM q
  UNION ALL SELECT 'websearch', n_nationkey, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'described' ELSE '' END, 'http://web/' || n_nationkey FROM q)
SELECT n_nationkey, p || '-' || base64(encode(url))[1:16] AS id, title, description, url, 'active' AS status, 50::INTEGER AS score FROM h""")
def provider_hits(t: Tables):
    """Hits of three sources in their own shapes; only the first four queries are asked."""
    k = F.col("n_nationkey")
    url = lambda name: F.concat(F.lit(f"http://{name}/"), k.cast("string")).alias("url")
    you = F.struct(F.array(F.struct(F.col("n_name").alias("title"), url("you"), F.lit("plain").alias("description"), F.when(k % 2 == 0, F.array(F.lit("one"), F.lit("two"))).otherwise(F.array().cast("array<string>")).alias("snippets"))).alias("hits"))
    lang = F.struct(F.struct(F.array(F.struct(F.col("n_name").alias("name"), url("lang"), F.lit("snippet").alias("snippet"))).alias("value")).alias("webPages"))
    own = F.array(F.struct(F.col("n_name").alias("title"), url("web"), F.when(k % 2 == 0, "described").alias("description")))
    web = F.struct(F.when(k % 2 == 0, own).alias("results"), F.when(k % 2 != 0, own).alias("organic"))
    rows = t.nation.select((k % 6).alias("i"), k, *[F.to_json(p).alias(n) for n, p in (("you", you), ("langsearch", lang), ("websearch", web))])
    found = [searches.provider_hits(rows, name, name, "i", ["n_nationkey"]) for name in searches.SHAPES]
    return found[0].unionByName(found[1]).unionByName(found[2]).select("n_nationkey", "id", "title", "description", "url", "status", "score")


@query("SRC22", """WITH p AS (SELECT q.vec_id AS query_id, r.vec_id AS vec_id, list_inner_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) / sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_inner_product(r.embedding::DOUBLE[], r.embedding::DOUBLE[])) AS score
FROM embeddings q, embeddings r WHERE q.vec_id % 100 = 0 AND q.vec_id <> r.vec_id)
SELECT query_id, CAST(pos AS INTEGER) AS pos, vec_id, CAST(floor(score * 1000000) AS BIGINT) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS pos FROM p) WHERE pos <= 10""")
def neural_search(t: Tables):
    """The ten rows nearest to each query vector, those whose id is divisible by 100."""
    found = neighbours.exact_nearest(t.embeddings, t.embeddings.where("vec_id % 100 = 0"), "vec_id", "embedding")
    return found.select(F.col("query").alias("query_id"), "pos", F.col("id").alias("vec_id"), F.floor(F.col("score") * 1_000_000).alias("score"))


PORTAL_SQL = _values([(i, *row) for i, row in enumerate(portals.PORTALS)]) + " AS p(pos, domain, name, state, tier)"
TERM_SQL = _values(list(enumerate(portals.TERMS))) + " AS t(term, text)"


@query("SRC26", f"""WITH b AS (SELECT tier AS batch, '(' || string_agg('site:' || domain, ' OR ' ORDER BY pos) || ') ' AS sites FROM {PORTAL_SQL} GROUP BY tier),
q AS (SELECT batch, term, sites, text FROM b, {TERM_SQL} UNION ALL SELECT 0, 0, '(' || string_agg('site:' || domain, ' OR ' ORDER BY pos) || ') ', '"{{keywords}}" RFP OR solicitation OR bid {{year}}' FROM {PORTAL_SQL}),
r AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN '  ' ELSE ' ' || s_name END AS keywords, 2020 + s_suppkey % 6 AS year FROM supplier)
SELECT s_suppkey, CAST(batch AS INTEGER) AS batch, CAST(term AS INTEGER) AS term, sites || replace(replace(text, '{{keywords}}', trim(keywords)), '{{year}}', CAST(year AS VARCHAR)) AS query FROM r, q WHERE batch > 0 OR trim(keywords) <> ''""")
def portal_searches(t: Tables):
    """Site searches of every tier of the registry for each request, its keywords' own search first."""
    k = F.col("s_suppkey")
    requests = t.supplier.select(k, F.when(k % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "s_name")).alias("keywords"), (k % 6 + 2020).alias("year"))
    return portals.searches_of(requests, "keywords", "year", with_third=True).select("s_suppkey", "batch", "term", "query")


@query("SRC26 PRJ05 JOI07", f"""WITH u AS (SELECT o_orderkey, 'www.' || coalesce(domain, 'none.example') AS host FROM orders LEFT JOIN {PORTAL_SQL} ON pos = o_orderkey % 26),
f AS (SELECT o_orderkey, arg_min(name, pos) AS n, arg_min(state, pos) AS s FROM u LEFT JOIN {PORTAL_SQL} ON contains(host, domain) GROUP BY o_orderkey)
SELECT o_orderkey, coalesce(n, 'State Portal') AS portal, CASE WHEN s IS NULL OR s = 'National' THEN 'Unknown' ELSE s || ' Government' END AS agency FROM f""")
def portal_names(t: Tables):
    """The registry's name and agency for a result's URL."""
    domains = F.array(*[F.lit(d) for d, *_ in portals.PORTALS])
    domain = F.coalesce(F.get(domains, (F.col("o_orderkey") % 26).cast("int")), F.lit("none.example"))
    rows = t.orders.select("o_orderkey", F.concat(F.lit("https://www."), domain, F.lit("/bids")).alias("url"))
    named = rows.select("o_orderkey", portals.portal_of(F.col("url")).alias("portal"), portals.portal_of(F.col("url"), "state", "National").alias("state"))
    return named.select("o_orderkey", "portal", F.when(F.col("state") == "National", "Unknown").otherwise(F.concat("state", F.lit(" Government"))).alias("agency"))


STATE_SQL = f"{_values([(i, *row) for i, row in enumerate(registry.STATES)])} AS s(pos, c, n, r, p)"


def _state_codes(key: str) -> Column:
    """A state's code for each row, by its key."""
    return F.get(F.array(*[F.lit(code) for code, *_ in registry.STATES]), (F.col(key) % len(registry.STATES)).cast("int"))


@query("SRC34 SRC35", f"""WITH stored AS (SELECT pos, count(*) AS k FROM supplier JOIN {STATE_SQL} ON pos = s_suppkey % 51 WHERE s_acctbal > 0 AND s_suppkey % 51 < 40 GROUP BY 1)
SELECT c AS state_code, CASE WHEN k IS NULL THEN n ELSE 'stored ' || c END AS state_name, CASE WHEN k IS NULL THEN r END AS region, coalesce(k, 0) AS suppliers FROM {STATE_SQL} LEFT JOIN stored USING (pos)""")
def seed_states(t: Tables):
    """States that suppliers are stored with stay as they are; the seed adds the rest."""
    rows = t.supplier.where("s_acctbal > 0 AND s_suppkey % 51 < 40").select(_state_codes("s_suppkey").alias("state_code"))
    stored = rows.groupBy("state_code").agg(F.concat(F.lit("stored "), F.first("state_code")).alias("state_name"), F.lit(None).cast("string").alias("region"), F.count("*").alias("suppliers"))
    seed = registry.states(t.spark).select("state_code", "state_name", "region", F.lit(0).cast("bigint").alias("suppliers"))
    return registry.seeded(stored, seed, "state_code")


@query("SRC37", """SELECT coalesce(c_custkey, s_suppkey) AS key, coalesce(CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_name END, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END) AS value FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""")
def effective_settings(t: Tables):
    """Settings stored for customers, those of the environment from suppliers; blank ones are missing."""
    db = t.customer.select(F.col("c_custkey").alias("key"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name")).alias("value"))
    env = t.supplier.select(F.col("s_suppkey").alias("key"), F.when(F.col("s_suppkey") % 5 == 0, "").otherwise(F.col("s_name")).alias("value"))
    return registry.setting(db, env)


@query("SRC28 AGG07 TOP04", """WITH k AS (SELECT *, CASE n_nationkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 'C' || n_nationkey ELSE 'Q' || n_nationkey END AS c FROM nation), m AS (SELECT *, CASE WHEN c IS NULL THEN NULL ELSE 40.0 + n_nationkey END AS paid FROM k)
SELECT n_nationkey, c AS committee_id, c || ' committee' AS committee, CASE WHEN c IS NULL THEN 0 ELSE 5 END::INTEGER AS n_cycles, CASE WHEN c IS NULL THEN 0 ELSE 30 * n_nationkey + 4 END::DOUBLE AS total_receipts, CASE WHEN c IS NULL THEN 0 ELSE 20 END::DOUBLE AS total_disbursements,
CASE WHEN c IS NULL THEN 0 ELSE 30 END::DOUBLE AS republican, CASE WHEN c IS NULL THEN 0 ELSE 10 END::DOUBLE AS democrat, CASE WHEN c IS NULL THEN 0 ELSE n_nationkey END::DOUBLE AS other,
coalesce(floor(30 / paid * 100 + 0.5), 0)::INTEGER AS republican_pct, coalesce(floor(10 / paid * 100 + 0.5), 0)::INTEGER AS democrat_pct, coalesce(floor(n_nationkey / paid * 100 + 0.5), 0)::INTEGER AS other_pct FROM m""")
def committee_finance(t: Tables):
    """From the search to a committee, its totals over four cycles, and the parties that it paid."""
    k = F.col("n_nationkey")
    named = lambda c, kind: F.struct(F.concat(F.lit(c), k.cast("string")).alias("committee_id"), F.concat(F.lit(c), k.cast("string"), F.lit(" committee")).alias("name"), F.lit(kind).alias("committee_type"))
    listed = F.when(k % 4 == 0, F.array().cast("array<struct<committee_id:string,name:string,committee_type:string>>")).when(k % 4 == 1, F.array(named("C", "N"))).otherwise(F.array(named("C", "N"), named("Q", "Q")))
    wrap = lambda items: F.to_json(F.struct(items.alias("results")))
    search = t.nation.select("n_nationkey", wrap(listed).alias("payload"))
    ids = t.nation.select(k, F.explode(F.array(F.lit("C"), F.lit("Q"))).alias("kind")).select(k, F.concat("kind", k.cast("string")).alias("committee_id"))
    cycles = F.array(*[F.struct(F.lit(2024 - 2 * i).alias("cycle"), (k * 10 + i if i != 2 else F.lit(None)).cast("double").alias("receipts"), F.lit(5.0).alias("disbursements")) for i in range(6)])
    paid = F.array(*[F.struct(F.lit(name).alias("recipient_name"), F.lit(amount).cast("double").alias("disbursement_amount") if amount else k.cast("double").alias("disbursement_amount")) for name, amount in (("RNC", 30), ("DCCC services", 10), ("Other", None))])
    return finance.finance_chain(search, "n_nationkey", "payload", ids.select("committee_id", wrap(cycles).alias("payload")), ids.select("committee_id", wrap(paid).alias("payload")))


TEMPLATE_SQL = _values([(b, i, q) for b, texts in templates.BUCKET_TEMPLATES.items() for i, q in enumerate(texts, 1)]) + " AS t(bucket, template, text)"


@query("SRC39 SRC34", f"SELECT s_suppkey, c AS state_code, bucket, CAST(template AS INTEGER) AS template, replace(text, '{{state}}', n) AS query FROM supplier JOIN {STATE_SQL} ON pos = s_suppkey % 51, {TEMPLATE_SQL}")
def bucket_queries(t: Tables):
    """All templates of all buckets, for the state of every supplier."""
    located = t.supplier.select("s_suppkey", _state_codes("s_suppkey").alias("state_code")).join(registry.states(t.spark).select("state_code", "state_name"), "state_code")
    return templates.bucket_queries(located).select("s_suppkey", "state_code", "bucket", "template", "query")


CHANNEL_SQL = _values([(i, c, n, q) for i, (c, texts) in enumerate(templates.CHANNEL_QUERIES.items()) for n, q in enumerate(texts, 1)]) + " AS t(pos, channel, template, query)"


@query("SRC39", f"SELECT o_orderkey, channel, CAST(template AS INTEGER) AS template, query FROM orders JOIN {CHANNEL_SQL} ON pos = o_orderkey % 5")
def channel_queries(t: Tables):
    """What is asked for each order in its channel; every fifth one has a channel without queries."""
    names = F.array(*[F.lit(c) for c in templates.CHANNEL_QUERIES])
    requests = t.orders.select("o_orderkey", F.coalesce(F.get(names, (F.col("o_orderkey") % 5).cast("int")), F.lit("other")).alias("channel"))
    return templates.channel_searches(requests, "channel").select("o_orderkey", "channel", "template", "query")


@query("SRC07", "SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'no file' WHEN p_size * 524288 > 10485760 THEN 'too large' ELSE 'accepted' END AS status FROM part")
def upload_statuses(t: Tables):
    size = F.when(F.col("p_partkey") % 10 != 0, F.col("p_size") * 512 * 1024)
    return t.part.select("p_partkey", remote.upload_status(size).alias("status"))


OUTCOMES_SQL = """SELECT event_id, CASE WHEN event_id % 7 = 0 OR event_id % 100 > 60 THEN 'timed out' WHEN event_id % 5 = 0 THEN 'failed' ELSE 'done' END AS status,
CASE WHEN event_id % 7 <> 0 AND event_id % 100 <= 60 AND event_id % 5 <> 0 AND event_id % 3 <> 0 THEN event_id % 90 END::INTEGER AS score FROM events"""


def _robot_tasks(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Starts of tasks, and their results: one of seven tasks has none, the others have two."""
    k = F.col("event_id")
    starts = t.events.select("event_id", F.col("ts").cast("timestamp").alias("started_at"))
    later = lambda seconds: F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + seconds * 1_000_000)
    answer = F.when(k % 3 == 0, "no idea").otherwise(F.concat(F.lit('```json\n{"score": '), (k % 90).cast("string"), F.lit("}\n```")))
    one = t.events.where(k % 7 != 0)
    results = one.select("event_id", later(k % 100).alias("finished_at"), (k % 5 == 0).alias("failed"), answer.alias("output"))
    again = one.select("event_id", later(k % 100 + 1).alias("finished_at"), F.lit(False).alias("failed"), F.lit("late").alias("output"))
    return starts, results.unionByName(again)


@query("SRC31 SRC33", OUTCOMES_SQL)
def task_outcomes(t: Tables):
    """Robots' tasks with their outputs as far as they came in time, and the models' answers in them."""
    done = remote.task_results(*_robot_tasks(t), "event_id", remote.ROBOT_WAIT)
    return done.select("event_id", "status", remote.model_reply(F.col("output"), "score int")["score"].alias("score"))


@query("SRC31 SRC33", OUTCOMES_SQL)
def task_timers(t: Tables):
    """The same tasks as a stream, whose timers end them."""
    done = tasks.outcomes_of(tasks.starts_and_results(*_robot_tasks(t), "event_id"), "event_id", remote.ROBOT_WAIT, scratch_folder(t.spark))
    return done.select("event_id", "status", remote.model_reply(F.col("output"), "score int")["score"].alias("score"))
