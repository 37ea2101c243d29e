"""Classifiers, scores, votes."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidweave.functions import rules, text
from bidweave.functions.dates import elapsed_days, moment, stamp
from bidweave.operators import scoring, voting
from bidweave.operators.dedupe import first_k
from bidweave.plans.registry import Tables, any_sql, case_sql, query

DOC = "lower(text || ' ' || source)"


def _doc():
    return text.joined("text", "source")


def _lower(words: list[str]) -> list[str]:
    return [w.lower() for w in words]


@query("CLS12 CLS13", f"SELECT doc_id, {case_sql(DOC, rules.ITEM_TYPE, 'news')} AS item_type, {case_sql(DOC, rules.SEVERITY, 'low')} AS severity FROM documents")
def classify_item(t: Tables):
    return t.documents.select("doc_id", rules.classify(_doc(), rules.ITEM_TYPE, "news").alias("item_type"), rules.classify(_doc(), rules.SEVERITY, "low").alias("severity"))


HEALTH_CASE = "(CASE " + " ".join(f"WHEN contains(x, '{k}') THEN '{k}'" for k in rules.HEALTH_KEYWORDS) + " END)"
TITLES = ["safety officer", "paramedic lead", "software developer", "wellness coach", "site medic", "clerk"]
TITLE_SQL = "['" + "', '".join(TITLES) + "'][p_size % 6 + 1]"


def _titles(t: Tables):
    title = F.element_at(F.array(*[F.lit(x) for x in TITLES]), F.col("p_size") % 6 + 1)
    return t.part.select("p_partkey", "p_size", F.lower(F.concat_ws(" ", title, "p_name")).alias("x"))


@query("CLS06 JOI08", f"SELECT p_partkey, {HEALTH_CASE} AS reason, {HEALTH_CASE} IS NOT NULL AS health FROM (SELECT p_partkey, lower({TITLE_SQL} || ' ' || p_name) AS x FROM part)")
def classify_first_keyword(t: Tables):
    rows = _titles(t).select("p_partkey", text.first_found(F.col("x"), rules.HEALTH_KEYWORDS).alias("reason"))
    return rows.withColumn("health", F.col("reason").isNotNull())


ROLES = ["Chief Executive (CEO)", "Treasurer", "HR lead", "EHS manager", "IT support", "Board Director", "Secretary of the agency", "Media relations", "Division head", "Parole counsel", "Quality lead", "Driver"]
ROLE_SQL = "['" + "', '".join(ROLES) + "'][p_size % 12 + 1]"
KEY_SQL = "('" + "', '".join(rules.KEY_CATEGORIES) + "')"


@query(
    "CLS10 CLS11",
    f"""WITH x AS (SELECT p_partkey, lower({ROLE_SQL}) AS r FROM part),
    y AS (SELECT *, CASE WHEN contains(r, 'secretary') AND contains(r, 'agency') THEN 'ceo_leadership' ELSE {case_sql('r', rules.CLIENT_CONTACT, 'other')} END AS client_category, {case_sql('r', rules.PROSPECT_CONTACT, 'other')} AS prospect_category FROM x),
    z AS (SELECT *, {any_sql("(client_category || ' ' || r)", rules.CLIENT_EHS_WORDS)} AS ehs, {any_sql("(r || ' ' || r)", rules.EHS_WORDS)} AS ehs_bulk FROM y)
    SELECT p_partkey, client_category, prospect_category, ehs, ehs_bulk, ehs OR client_category IN {KEY_SQL} AS key_contact FROM z""",
)
def classify_contact(t: Tables):
    role = F.lower(F.element_at(F.array(*[F.lit(x) for x in ROLES]), F.col("p_size") % 12 + 1))
    rows = t.part.select("p_partkey", role.alias("r")).select("*", rules.client_contact(F.col("r")).alias("client_category"), rules.classify(F.col("r"), rules.PROSPECT_CONTACT, "other").alias("prospect_category"))
    flagged = rows.withColumns({"ehs": text.has_any(text.joined("client_category", "r"), rules.CLIENT_EHS_WORDS), "ehs_bulk": text.has_any(text.joined("r", "r"), rules.EHS_WORDS)})
    return flagged.withColumn("key_contact", F.col("ehs") | F.col("client_category").isin(rules.KEY_CATEGORIES)).drop("r")


@query(
    "CLS07 CLS08",
    """SELECT c_custkey, CASE WHEN n >= 15 THEN 'high' WHEN n >= 5 THEN 'medium' WHEN n >= 1 THEN 'low' ELSE 'none' END AS level, CASE WHEN n > 10 THEN 'growing' WHEN n > 0 THEN 'stable' ELSE 'contracting' END AS trend,
    CASE WHEN n > 10 THEN n || ' open positions found. Active hiring activity.' WHEN n > 3 THEN n || ' open positions found. Moderate hiring activity.' WHEN n > 0 THEN n || ' open position(s) found. Limited hiring activity.' ELSE 'No open positions found in recent search.' END AS summary
    FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1)""",
)
def hiring_level(t: Tables):
    counts = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return t.customer.join(counts, "c_custkey", "left").select("c_custkey", rules.hiring_level(n).alias("level"), rules.hiring_trend(n).alias("trend"), rules.hiring_sentence(n).alias("summary"))


PLACES = ["Corporate Office HQ", "Assembly plant", "R&D lab", "Depot", "Field operations", "Datacenter", "Training range", "Warehouse", "Service center", "Tower"]
PLACE_SQL = "['" + "', '".join(PLACES) + "'][CAST(s_suppkey % 10 AS INTEGER) + 1]"


@query("CLS01 CLS02", f"SELECT s_suppkey, {case_sql('x', rules.BRANCH_TYPE, 'office')} AS branch_type, {case_sql('x', rules.LOCATION_TYPE, 'office')} AS location_type FROM (SELECT s_suppkey, lower({PLACE_SQL}) AS x FROM supplier)")
def classify_place(t: Tables):
    place = F.lower(F.element_at(F.array(*[F.lit(x) for x in PLACES]), (F.col("s_suppkey") % 10 + 1).cast("int")))
    return t.supplier.select("s_suppkey", rules.classify(place, rules.BRANCH_TYPE, "office").alias("branch_type"), rules.classify(place, rules.LOCATION_TYPE, "office").alias("location_type"))


JOBS = ["Software developer, part-time", "Supply chain contractor", "HR intern", "Machinist production", "Cyber security", "Program Manager", "Medical data entry", "Finance", "Engineer", "Cook"]
JOB_SQL = "['" + "', '".join(JOBS) + "'][CAST(s_suppkey % 10 AS INTEGER) + 1]"
HEALTH_SQL = any_sql("x", rules.HEALTH_KEYWORDS)


@query(
    "CLS03 CLS04 CLS05 CLS09",
    f"""SELECT s_suppkey, {case_sql('x', rules.BRANCH_DEPARTMENT, 'General')} AS branch_department, CASE WHEN {HEALTH_SQL} THEN 'Health & Safety' ELSE {case_sql('x', rules.JOB_DEPARTMENT, 'General')} END AS job_department,
    {case_sql('x', rules.JOB_TYPE, 'full-time')} AS job_type, CASE s_suppkey % 3 WHEN 0 THEN 'LinkedIn' WHEN 1 THEN 'Indeed' ELSE 'Web' END AS site FROM (SELECT s_suppkey, lower({JOB_SQL}) AS x FROM supplier)""",
)
def classify_department(t: Tables):
    rows = t.supplier.select("s_suppkey", F.lower(F.element_at(F.array(*[F.lit(x) for x in JOBS]), (F.col("s_suppkey") % 10 + 1).cast("int"))).alias("x"))
    x = F.col("x")
    link = F.when(F.col("s_suppkey") % 3 == 0, "https://linkedin.com/j").when(F.col("s_suppkey") % 3 == 1, "https://indeed.com/j").otherwise("https://a.b/j")
    return rows.select(
        "s_suppkey",
        rules.classify(x, rules.BRANCH_DEPARTMENT, "General").alias("branch_department"),
        F.when(text.has_any(x, rules.HEALTH_KEYWORDS), "Health & Safety").otherwise(rules.classify(x, rules.JOB_DEPARTMENT, "General")).alias("job_department"),
        rules.classify(x, rules.JOB_TYPE, "full-time").alias("job_type"),
        rules.classify(link, rules.POSTING_SITE, "Web").alias("site"),
    )


NEWS = ["RFP for services", "award given", "new facility", "Wellness day", "nothing", "selected bidder"]
NEWS_SQL = "lower(['" + "', '".join(NEWS) + "'][CAST(doc_id % 6 AS INTEGER) + 1])"


@query(
    "CLS14 CLS19 CLS20",
    f"""SELECT doc_id, {case_sql(NEWS_SQL, rules.SIGNAL_TYPE, None)} AS signal, CASE WHEN n >= 70 THEN 'high' WHEN n >= 45 THEN 'medium' ELSE 'low' END AS band, CASE WHEN regexp_matches('Level ' || (doc_id % 5) || ' advisory', '(?i)level [34]|do not travel|reconsider') THEN 'high' ELSE 'other' END AS advisory
    FROM (SELECT *, doc_id % 100 AS n FROM documents) WHERE {case_sql(NEWS_SQL, rules.SIGNAL_TYPE, None)} IS NOT NULL""",
)
def classify_misc(t: Tables):
    from bidweave.sources.feeds import HIGH_ADVISORY

    news = F.lower(F.element_at(F.array(*[F.lit(x) for x in NEWS]), (F.col("doc_id") % 6 + 1).cast("int")))
    rows = t.documents.select("doc_id", rules.classify(news, rules.SIGNAL_TYPE).alias("signal")).where("signal is not null")
    level = F.concat(F.lit("Level "), (F.col("doc_id") % 5).cast("string"), F.lit(" advisory"))
    return rows.select("doc_id", "signal", rules.score_band(F.col("doc_id") % 100).alias("band"), F.when(level.rlike(HIGH_ADVISORY), "high").otherwise("other").alias("advisory"))


POINTS = " + ".join(f"CASE WHEN contains(x, '{w}') THEN 10 ELSE 0 END" for w in _lower(scoring.RELEVANCE_WORDS))


@query("SCO09 JOI08", f"SELECT doc_id, CAST(least(100, {POINTS}) AS INTEGER) AS score FROM (SELECT doc_id, {DOC} AS x FROM documents)")
def keyword_score(t: Tables):
    return t.documents.select("doc_id", scoring.keyword_relevance(_doc()).alias("score"))


AS_OF = "1998-06-15"
DAYS_SQL = "CAST(floor((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1998-06-15')) / 86400000000) AS BIGINT)"


@query(
    "SCO01 RNK01 DAT04 DAT05",
    f"""WITH x AS (SELECT o_orderkey, o_orderstatus, {DAYS_SQL} AS d, CAST(o_orderkey % 3 AS VARCHAR) AS naics, CASE WHEN o_orderkey % 4 = 0 THEN 'WOSB ' || o_orderpriority WHEN o_orderkey % 4 = 1 THEN 'Tribal' END AS aside, lower('Order ' || c_mktsegment || ' ' || c_name) AS txt FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN 20 ELSE 0 END + 10 + CASE WHEN d BETWEEN 1 AND 14 THEN 15 ELSE 0 END + 5 + CASE WHEN naics = '1' THEN 20 ELSE 0 END + 5 + 5 + CASE WHEN contains(lower(aside), 'wosb') THEN 15 ELSE 0 END + CASE WHEN contains(lower(aside), 'tribal') THEN 10 ELSE 0 END + CASE WHEN contains(txt, 'building') THEN 10 ELSE 0 END + CASE WHEN contains(txt, 'machine') THEN 10 ELSE 0 END AS INTEGER) AS score,
    concat_ws('; ', CASE WHEN o_orderstatus = 'O' THEN 'Active opportunity' END, CASE WHEN d > 0 THEN 'Response due in ' || d || ' days' END, CASE WHEN naics = '1' THEN 'Matching NAICS: 1' END, CASE WHEN contains(lower(aside), 'wosb') THEN 'Set-aside: ' || aside END, CASE WHEN contains(txt, 'building') THEN 'Keyword match: Building' END, CASE WHEN contains(txt, 'machine') THEN 'Keyword match: machine' END) AS signals FROM x""",
)
def opportunity_score(t: Tables):
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    k = F.col("o_orderkey")
    aside = F.when(k % 4 == 0, F.concat(F.lit("WOSB "), F.col("o_orderpriority"))).when(k % 4 == 1, "Tribal")
    rows = rows.select("o_orderkey", F.when(F.col("o_orderstatus") == "O", "active").otherwise("archived").alias("status"), stamp("o_orderdate").alias("deadline"), (k % 3).cast("string").alias("naics"), aside.alias("aside"), F.lower(F.concat_ws(" ", F.lit("Order"), "c_mktsegment", "c_name")).alias("txt"))
    score, signals = scoring.opportunity(F.col("status"), F.col("deadline"), F.col("naics"), F.lit("d"), F.lit("u"), F.col("aside"), F.col("txt"), moment(AS_OF), ["1"], ["Building", "machine"], ["tribal"])
    return rows.select("o_orderkey", score.alias("score"), F.array_join(signals, "; ").alias("signals"))


AGENCIES = ["Department of Defense", "Interior", "Homeland Security", "Parks", "Health"]
AGENCY_SQL = "lower(['" + "', '".join(AGENCIES) + "'][CAST(l_suppkey % 5 AS INTEGER) + 1])"
RECOMPETE_SQL = f"""SELECT l_orderkey, l_linenumber, CAST(floor((epoch_us(l_shipdate) - epoch_us(TIMESTAMP '1998-06-15')) / 86400000000) AS BIGINT) AS d, {AGENCY_SQL} AS a, l_extendedprice * 100 AS amount FROM lineitem"""
SCORE_SQL = f"CAST(least(100, 20 + CASE WHEN {any_sql('a', scoring.RECOMPETE_AGENCIES)} THEN 25 ELSE 0 END + CASE WHEN d < 365 THEN 30 WHEN d < 548 THEN 15 ELSE 0 END + CASE WHEN amount > 1000000 THEN 15 ELSE 0 END) AS INTEGER)"


def _awards(t: Tables):
    agency = F.lower(F.element_at(F.array(*[F.lit(x) for x in AGENCIES]), (F.col("l_suppkey") % 5 + 1).cast("int")))
    return t.lineitem.select("l_orderkey", "l_linenumber", elapsed_days(stamp("l_shipdate"), moment(AS_OF)).alias("d"), agency.alias("a"), (F.col("l_extendedprice") * 100).alias("amount"))


@query("SCO03 CLS18 DAT04 DAT05", f"SELECT l_orderkey, l_linenumber, d AS days, {SCORE_SQL} AS score, CASE WHEN d < 548 THEN 'recompete-window' ELSE 'active' END AS status FROM ({RECOMPETE_SQL})")
def recompete_score(t: Tables):
    return _awards(t).select("l_orderkey", "l_linenumber", F.col("d").alias("days"), scoring.recompete(F.col("a"), F.col("d"), F.col("amount")).alias("score"), F.when(F.col("d") < 548, "recompete-window").otherwise("active").alias("status"))


@query("CLS17 AGG02", f"SELECT CASE WHEN s >= 70 THEN 'pursue' WHEN s >= 45 THEN 'monitor' ELSE 'wait' END AS tag, count(*) AS n FROM (SELECT {SCORE_SQL} AS s FROM ({RECOMPETE_SQL})) GROUP BY 1")
def action_tags(t: Tables):
    return _awards(t).groupBy(rules.action_tag(scoring.recompete(F.col("a"), F.col("d"), F.col("amount"))).alias("tag")).agg(F.count("*").alias("n"))


FAMILY = ["department of defense drug testing", "health workforce of hhs", "osha worker health rule", "state land", "621111 medical homeland"]
FAMILY_SQL = "['" + "', '".join(FAMILY) + "'][CAST(s_suppkey % 5 AS INTEGER) + 1]"


def _points(*parts: tuple[str, int], base: int) -> str:
    return f"CAST(least(100, {base} + " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in parts) + ") AS INTEGER)"


@query(
    "SCO02 SCO04 SCO05 SCO06 SCO07 SCO08",
    f"""SELECT s_suppkey, {_points((any_sql('x', scoring.FORECAST_AGENCIES), 25), (any_sql('x', scoring.FORECAST_TERMS), 35), (any_sql('x', scoring.FORECAST_CODES), 20), base=20)} AS forecast,
    {_points((any_sql('x', scoring.OVERSIGHT_TERMS), 30), (any_sql('x', scoring.OVERSIGHT_AGENCIES), 25), base=25)} AS oversight,
    {_points((any_sql('x', scoring.POLICY_TERMS), 40), ("s_suppkey % 2 = 0", 20), base=20)} AS policy,
    {_points((any_sql('x', scoring.INCUMBENT_AGENCIES), 30), ("m > 5000000", 25), ("m > 1000000 AND m <= 5000000", 15), base=30)} AS incumbent,
    {_points((any_sql('x', scoring.LEADERSHIP_AGENCIES), 30), (any_sql('x', scoring.LEADERSHIP_TERMS), 25), base=30)} AS leadership,
    {_points((any_sql('x', scoring.BUDGET_TERMS), 35), (any_sql('x', scoring.BUDGET_AGENCIES), 25), base=20)} AS budget
    FROM (SELECT *, {FAMILY_SQL} AS x, s_acctbal * 1000 AS m FROM supplier)""",
)
def score_family(t: Tables):
    rows = t.supplier.select("s_suppkey", F.element_at(F.array(*[F.lit(x) for x in FAMILY]), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("x"), (F.col("s_acctbal") * 1000).alias("m"))
    x = F.col("x")
    return rows.select(
        "s_suppkey",
        scoring.forecast(x).alias("forecast"),
        scoring.oversight(x, x).alias("oversight"),
        scoring.policy(x, F.when(F.col("s_suppkey") % 2 == 0, "RULE").otherwise("NOTICE")).alias("policy"),
        scoring.incumbent(x, F.col("m")).alias("incumbent"),
        scoring.leadership(x, x).alias("leadership"),
        scoring.budget(x).alias("budget"),
    )


VOTES_SQL = """WITH v AS (SELECT l_orderkey AS id, l_linenumber AS r, 'scorer' || l_linenumber AS scorer, CASE WHEN l_orderkey % 10 = 0 THEN NULL ELSE CAST(l_quantity * 2 AS INTEGER) END AS score FROM lineitem),
a AS (SELECT id, count(score) AS n, count(*) FILTER (score >= 55) AS p, CAST(floor(avg(CAST(score AS DOUBLE)) + 0.5) AS BIGINT) AS m, arg_max(scorer, struct_pack(s := score, r := r)) FILTER (score IS NOT NULL) AS w FROM v GROUP BY id)
SELECT id, CASE WHEN n = 0 THEN 40 ELSE m END AS final_score, CASE WHEN n = 0 THEN true ELSE {rule} AND m >= 50 END AS passed, coalesce(w, 'fallback') AS winner, n AS n_votes FROM a"""


def _votes(t: Tables):
    score = F.when(F.col("l_orderkey") % 10 == 0, F.lit(None)).otherwise((F.col("l_quantity") * 2).cast("int"))
    return t.lineitem.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("r"), F.concat(F.lit("scorer"), F.col("l_linenumber").cast("string")).alias("scorer"), score.alias("score"))


@query("VOT01 AGG20", VOTES_SQL.format(rule="p = n"))
def votes_consensus(t: Tables):
    return voting.combined(_votes(t), "id", "r", "scorer", "score", "consensus")


@query("VOT01 AGG20", VOTES_SQL.format(rule="p > n / 2"))
def votes_majority(t: Tables):
    return voting.combined(_votes(t), "id", "r", "scorer", "score", "majority")


@query("VOT01 AGG20", VOTES_SQL.format(rule="p >= 1"))
def votes_union(t: Tables):
    return voting.combined(_votes(t), "id", "r", "scorer", "score", "union")


@query(
    "VOT02",
    """WITH e AS (SELECT user_id, event_id, value, nullif(event_type, 'click') AS agency, CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value END AS estimate FROM events)
    SELECT user_id, max(value) AS best_score, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS best_scorer, arg_max(agency, struct_pack(v := value, e := -event_id)) FILTER (coalesce(agency, '') <> '') AS agency, arg_max(estimate, struct_pack(v := value, e := -event_id)) FILTER (estimate <> 0) AS estimate FROM e GROUP BY user_id""",
)
def best_extraction_fill(t: Tables):
    e = t.events.select("user_id", "event_id", "value", F.nullif("event_type", F.lit("click")).alias("agency"), F.when(F.col("event_id") % 3 == 0, 0.0).otherwise(F.col("value")).alias("estimate"))
    return voting.filled_best(e, "user_id", "value", "event_id", ["agency", "estimate"])


@query("VOT03", "SELECT quality AS grp, bool_or(toxic = 1) AS any_positive, CASE WHEN bool_or(toxic = 1) THEN 'opportunity' ELSE 'rejected' END AS verdict FROM labels GROUP BY quality")
def votes_negative(t: Tables):
    positive = F.bool_or(F.col("toxic") == 1)
    return t.labels.groupBy(F.col("quality").alias("grp")).agg(positive.alias("any_positive"), F.when(positive, "opportunity").otherwise("rejected").alias("verdict"))


@query("VOT04", "SELECT l_orderkey, string_agg(l_linenumber || ':' || CAST(l_quantity AS INTEGER), ', ' ORDER BY l_linenumber, l_linenumber || ':' || CAST(l_quantity AS INTEGER)) AS votes FROM lineitem GROUP BY 1")
def vote_list(t: Tables):
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(":"), F.col("l_quantity").cast("int").cast("string"))
    return voting.vote_list(t.lineitem, "l_orderkey", "l_linenumber", line).select("l_orderkey", F.array_join("votes", ", ").alias("votes"))


def _holds(word: str):
    return lambda x: F.contains(x, F.lit(word))


@query("AGG16", "SELECT p_partkey, " + ", ".join(f"CAST(contains(s, '{c.split()[0].lower()}') AS INTEGER) AS c{i}" for i, c in enumerate(rules.SERVICE_CATEGORIES)) + " FROM (SELECT p_partkey, lower(['Drug screens', 'Telehealth visits', 'DOT exams', 'Onsite nurse', 'Mental care'][p_size % 5 + 1] || '|' || p_type) AS s FROM part)")
def one_hot(t: Tables):
    offer = F.element_at(F.array(*[F.lit(x) for x in ("Drug screens", "Telehealth visits", "DOT exams", "Onsite nurse", "Mental care")]), F.col("p_size") % 5 + 1)
    services = t.part.select("p_partkey", F.array(F.lower(offer), F.lower("p_type")).alias("s"))
    return services.select("p_partkey", *[F.exists("s", _holds(c.split()[0].lower())).cast("int").alias(f"c{i}") for i, c in enumerate(rules.SERVICE_CATEGORIES)])


@query("TOP04", "SELECT o_custkey, arg_min(o_orderkey, struct_pack(a := CASE WHEN o_orderstatus = 'P' THEN 0 ELSE 1 END, b := o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def pick_preferred(t: Tables):
    rows = t.orders.select("o_custkey", "o_orderkey", (F.col("o_orderstatus") != "P").cast("int").alias("a"))
    return rows.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("a", "o_orderkey")).alias("o_orderkey"))


@query("RNK02 RNK03", "SELECT event_type, event_id, 'serper-' || (rn - 1) AS label FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 20")
def first_k_per_source(t: Tables):
    top = first_k(t.events.select("event_type", "event_id", "value"), ["event_type"], [F.desc("value"), F.asc("event_id")], 20)
    return top.select("event_type", "event_id", F.concat(F.lit("serper-"), (F.col("pos") - 1).cast("string")).alias("label"))
