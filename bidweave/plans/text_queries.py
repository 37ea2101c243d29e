"""Ids, hosts, cleaning, extraction, dates and display, over text composed from the tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave.functions import dates, text
from bidweave.functions.rules import confidence
from bidweave.operators import filters
from bidweave.operators.dedupe import best_by
from bidweave.plans.registry import Tables, query
from bidweave.plans.search import HOST_SQL
from bidweave.sources.feeds import title_country
from bidweave.sources.registry import STATE_CODES


@query(
    "STR11 STR12 STR13",
    """SELECT page_id, 'web-' || substr(sha256(url), 1, 20) AS web_id, base64(encode(url))[1:16] AS short_id,
    substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS item_id
    FROM (SELECT *, sha256('forecast::' || url) AS h FROM pages)""",
)
def url_ids(t: Tables):
    return t.pages.select("page_id", text.url_id("url").alias("web_id"), text.short_base64("url").alias("short_id"), text.item_id(F.lit("forecast"), "url").alias("item_id"))


@query("STR10 AGG02", f"SELECT {HOST_SQL} AS host, count(*) AS n FROM pages GROUP BY 1")
def host_counts(t: Tables):
    return t.pages.groupBy(text.url_host("url").alias("host")).agg(F.count("*").alias("n"))


@query(
    "STR14 SRC25",
    r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', ' ', 'g'), '(?is)<style[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]+>', ' ', 'g'),
    '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM pages""",
)
def html_text(t: Tables):
    return t.pages.select("page_id", text.html_text("html").alias("body"))


@query(
    "STR02 STR03",
    """SELECT n_nationkey, trim(split_part(p, '.', 1)) AS agency, nullif(trim(split_part(p, '.', 2)), '') AS sub_agency, concat_ws(', ', nullif(n_name, 'NATION_3'), r_name, 'US') AS place
    FROM (SELECT *, r_name || ' . ' || n_name || '. office' AS p FROM nation JOIN region ON n_regionkey = r_regionkey)""",
)
def split_path(t: Tables):
    rows = t.nation.join(F.broadcast(t.region), F.col("n_regionkey") == F.col("r_regionkey"))
    path = F.split(F.concat(F.col("r_name"), F.lit(" . "), F.col("n_name"), F.lit(". office")), r"\.")
    part = lambda i: F.nullif(F.trim(F.try_element_at(path, F.lit(i))), F.lit(""))
    return rows.select("n_nationkey", part(1).alias("agency"), part(2).alias("sub_agency"), F.concat_ws(", ", F.nullif("n_name", F.lit("NATION_3")), F.col("r_name"), F.lit("US")).alias("place"))


@query(
    "STR05 STR06",
    r"""SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '#+\s*', '', 'g'), '\*+', '', 'g'), '\n+', ' ', 'g'), '\s{2,}', ' ', 'g')) AS plain,
    substring(trim(regexp_replace(job, '(?s)\s*[-|–].*$', '')), 1, 150) AS title
    FROM (SELECT p_partkey, '## ' || p_name || chr(10) || chr(10) || '**' || p_brand || '**   x' AS md, p_name || ' – ' || p_type || ' | site' AS job FROM part)""",
)
def clean_title(t: Tables):
    md = F.concat(F.lit("## "), F.col("p_name"), F.lit("\n\n**"), F.col("p_brand"), F.lit("**   x"))
    return t.part.select("p_partkey", text.strip_markdown(md).alias("plain"), text.job_title(F.concat(F.col("p_name"), F.lit(" – "), F.col("p_type"), F.lit(" | site"))).alias("title"))


@query(
    "STR08 STR09",
    """WITH RECURSIVE h(k, name, i, v) AS (SELECT c_custkey, c_name, 0, CAST(0 AS BIGINT) FROM customer UNION ALL SELECT k, name, i + 1, (v * 31 + ascii(name[i + 1])) % 4294967296 FROM h WHERE i < length(name))
    SELECT c_custkey, upper(array_to_string(list_transform(list_filter(string_split_regex(trim(label), '\\s+'), lambda x: x <> '')[1:2], lambda x: x[1]), '')) AS initials, CAST(v % 6 AS INTEGER) AS color
    FROM (SELECT c_custkey, c_name, replace(c_name, '#', ' ') || ' ' || c_mktsegment AS label FROM customer) JOIN h ON k = c_custkey AND i = length(name)""".replace("\\\\", "\\"),
)
def initials_hash(t: Tables):
    label = F.concat(F.replace(F.col("c_name"), F.lit("#"), F.lit(" ")), F.lit(" "), F.col("c_mktsegment"))
    return t.customer.select("c_custkey", text.initials(label).alias("initials"), text.color_index("c_name").alias("color"))


def _money_text() -> Column:
    cents = F.format_number(F.col("o_totalprice"), 2)
    return F.concat(
        F.lit("Value: "),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("$"), F.substring(F.col("o_orderkey").cast("string"), 1, 2), F.lit(".5 million")))
        .when(F.col("o_orderkey") % 5 == 1, F.concat(F.lit("$"), F.substring(F.col("o_orderkey").cast("string"), 1, 3), F.lit("K")))
        .when(F.col("o_orderkey") % 5 == 2, F.concat(cents, F.lit(" dollars")))
        .when(F.col("o_orderkey") % 5 == 3, F.concat(F.lit("$"), cents))
        .otherwise("none"),
    )


MONEY_TEXT = """'Value: ' || CASE o_orderkey % 5 WHEN 0 THEN '$' || CAST(o_orderkey AS VARCHAR)[1:2] || '.5 million' WHEN 1 THEN '$' || CAST(o_orderkey AS VARCHAR)[1:3] || 'K'
    WHEN 2 THEN format('{:,.2f}', o_totalprice) || ' dollars' WHEN 3 THEN '$' || format('{:,.2f}', o_totalprice) ELSE 'none' END"""
MONEY_RE, DOLLARS_RE = r"(?i)\$\s*(\d{1,3}(?:,\d{3})*(?:\.\d+)?)\s*(million|M\b|billion|B\b|thousand|K\b)?", r"(?i)(\d{1,3}(?:,\d{3})+)\s+dollars?"


@query(
    "REG02 REG05",
    rf"""WITH x AS (SELECT o_orderkey, {MONEY_TEXT} AS s FROM orders),
    y AS (SELECT *, lower(regexp_extract(s, '{MONEY_RE}', 2)) AS u, TRY_CAST(replace(regexp_extract(s, '{MONEY_RE}', 1), ',', '') AS DOUBLE) AS a, TRY_CAST(replace(regexp_extract(s, '{DOLLARS_RE}', 1), ',', '') AS DOUBLE) AS b,
      lower(regexp_extract(replace(s, ',', ''), '(?i)\$?([\d.]+)\s*(million|billion|M|B)?', 2)) AS mu, TRY_CAST(regexp_extract(replace(s, ',', ''), '(?i)\$?([\d.]+)\s*(million|billion|M|B)?', 1) AS DOUBLE) AS mn FROM x),
    z AS (SELECT *, a * CASE WHEN u LIKE 'b%' THEN 1e9 WHEN u LIKE 'm%' THEN 1e6 WHEN u LIKE 'k%' OR u = 'thousand' THEN 1e3 ELSE 1 END AS v FROM y)
    SELECT o_orderkey, coalesce(CASE WHEN v BETWEEN 1e3 AND 1e10 THEN v END, CASE WHEN b BETWEEN 1e3 AND 1e10 THEN b END) AS value, coalesce(CASE WHEN mu LIKE 'b%' THEN mn * 1000 WHEN mu LIKE 'm%' THEN mn ELSE mn / 1000000 END, 0.0) AS millions FROM z""",
)
def money_extract(t: Tables):
    s = _money_text()
    return t.orders.select("o_orderkey", text.estimated_value(s).alias("value"), text.millions(s).alias("millions"))


@query(
    "REG01",
    """SELECT event_id, CASE WHEN event_id % 6 IN (0, 1, 2, 3) THEN CAST(ts AS DATE) END AS deadline FROM events""",
)
def deadline_extract(t: Tables):
    ts = F.col("ts")
    s = (
        F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("Proposals due: "), F.date_format(ts, "MMMM d, yyyy")))
        .when(F.col("event_id") % 6 == 1, F.concat(F.date_format(ts, "MMM d, yyyy"), F.lit(" – due at noon")))
        .when(F.col("event_id") % 6 == 2, F.concat(F.lit("Deadline: "), F.date_format(ts, "yyyy-MM-dd")))
        .when(F.col("event_id") % 6 == 3, F.concat(F.lit("closes "), F.date_format(ts, "MM/dd/yyyy")))
        .when(F.col("event_id") % 6 == 4, "due: March 5, 2023")
        .otherwise("posted 2 days ago")
    )
    return t.events.select("event_id", text.deadline(s).alias("deadline"))


@query(
    "REG03 REG04",
    """SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'Springfield' WHEN 1 THEN 'Orange County' WHEN 2 THEN 'Metro Water' END AS agency,
    CASE n_nationkey % 4 WHEN 0 THEN 'Springfield' WHEN 1 THEN 'Orange County' WHEN 3 THEN 'Northern Health' END AS title_agency FROM nation""",
)
def agency_extract(t: Tables):
    k = F.col("n_nationkey") % 4
    s = F.when(k == 0, "City of Springfield RFP for services").when(k == 1, "bids at Orange County offices").when(k == 2, "from the Metro Water Authority").otherwise("Northern Health RFP of City of For Request")
    title = F.when(k == 0, "[PDF] City of Springfield RFP").when(k == 1, "bids at Orange County").when(k == 2, "tiny ABC").otherwise("Northern Health RFP 2025")
    return t.nation.select("n_nationkey", text.agency(F.when(k == 3, "nothing here").otherwise(s)).alias("agency"), text.title_agency(title).alias("title_agency"))


CODES_SQL = "[" + ", ".join(f"'{c}'" for c in STATE_CODES) + "]"


@query(
    "REG11 DED03",
    r"""WITH x AS (SELECT n_nationkey AS id, 'Offices in Fair Haven, CT and ' || CASE WHEN n_nationkey % 2 = 0 THEN 'Boston, MA; ' ELSE 'Nowhere, ZZ; ' END || 'also Lyon, France; ' || CASE WHEN n_nationkey % 3 = 0 THEN 'Brazil' ELSE '' END AS s FROM nation),
    hits AS (SELECT id, unnest(regexp_extract_all(s, '\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)?,\s*[A-Z]{2}\b')) AS m FROM x),
    us AS (SELECT id, regexp_extract(m, '^(.*),', 1) AS city, right(m, 2) AS state, 'United States' AS country FROM hits WHERE list_contains("""
    + CODES_SQL
    + r""", right(m, 2))),
    abroad AS (SELECT id, nullif(regexp_extract(s, '([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s*,?\s*' || c, 1), '') AS city, '' AS state, c AS country FROM x, (SELECT unnest(['France', 'Brazil', 'Germany']) AS c) WHERE contains(s, c)),
    u AS (SELECT * FROM us UNION ALL SELECT * FROM abroad)
    SELECT lower(coalesce(city, '')) || '|' || lower(country) AS key, min(id) AS id, arg_min(state, id) AS state FROM u GROUP BY 1""",
)
def location_extract(t: Tables):
    s = F.concat(F.lit("Offices in Fair Haven, CT and "), F.when(F.col("n_nationkey") % 2 == 0, "Boston, MA; ").otherwise("Nowhere, ZZ; "), F.lit("also Lyon, France; "), F.when(F.col("n_nationkey") % 3 == 0, "Brazil").otherwise(""))
    rows = t.nation.select(F.col("n_nationkey").alias("id"), s.alias("s"))
    hit = F.explode(F.regexp_extract_all("s", F.lit(r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)?,\s*[A-Z]{2}\b"), F.lit(0)))
    us = rows.select("id", hit.alias("m")).select("id", F.regexp_extract("m", "^(.*),", 1).alias("city"), F.right("m", F.lit(2)).alias("state"), F.lit("United States").alias("country")).where(F.col("state").isin(STATE_CODES))
    countries = ["France", "Brazil", "Germany"]
    found = F.explode(F.array_compact(F.array(*[F.when(F.contains(F.col("s"), F.lit(c)), F.struct(text.group(F.col("s"), rf"([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s*,?\s*{c}").alias("city"), F.lit("").alias("state"), F.lit(c).alias("country"))) for c in countries])))
    abroad = rows.select("id", found.alias("f")).select("id", "f.*")
    keyed = us.unionByName(abroad).withColumn("key", F.concat_ws("|", F.lower(F.coalesce("city", F.lit(""))), F.lower("country")))
    return best_by(keyed, ["key"], ["id", "state"]).select("key", "id", "state")


@query(
    "REG07 REG08 REG09",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN replace(format('{:,.2f}', o_totalprice), ',', '') END AS penalty, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 9 AS INTEGER) END AS violations,
    'TX' AS state, strftime(o_orderdate, '%Y-%m-%d') AS posted, CASE WHEN o_orderkey % 2 = 0 THEN 'Navy Yard' ELSE 'Government Agency' END AS agency FROM orders""",
)
def contract_facts(t: Tables):
    k = F.col("o_orderkey")
    snippet = F.concat(
        F.lit("in TX on "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.when(k % 2 == 0, F.concat(F.lit(" fined $"), F.format_number("o_totalprice", 2))).otherwise(""), F.when(k % 3 == 0, F.concat(F.lit(" "), (k % 9).cast("string"), F.lit(" serious violations"))).otherwise("")
    )
    title = F.when(k % 2 == 0, "Navy Yard - award of work").otherwise("award of work")
    return t.orders.select(
        "o_orderkey",
        F.regexp_replace(text.group(snippet, r"(\$[\d,]+(?:\.\d{2})?)"), "[$,]", "").alias("penalty"),
        text.group(snippet, r"(?i)(\d+)\s+(?:serious\s+)?violation").try_cast("int").alias("violations"),
        text.group(snippet, r"\b([A-Z]{2})\b").alias("state"),
        text.group(snippet, text.RELATIVE_DATE).alias("posted"),
        F.coalesce(F.nullif(F.trim(F.regexp_extract(title, r"^([^|–-]+)\s*[|–-]", 1)), F.lit("")), F.lit("Government Agency")).alias("agency"),
    )


LABELS = {"P": "Pending", "O": "Open order"}


@query(
    "STR04 STR07 STR15 STR16 STR17 STR18 STR19 JOI11",
    r"""SELECT o_orderkey, array_to_string(list_filter(list_transform(string_split(o_orderpriority || ', ,x ,' || o_orderstatus, ','), lambda x: upper(trim(x))), lambda x: x <> ''), '+') AS parts,
    'Acme Tools ' || o_orderkey AS company, '{"a": ' || o_orderkey || '}' AS fenced, contains('a.b', '.') AS literal_dot,
    CASE o_orderstatus WHEN 'P' THEN 'Pending' WHEN 'O' THEN 'Open order' ELSE 'F' END AS label,
    CASE WHEN o_totalprice >= 1000000 THEN '$' || format('{:.1f}', floor(o_totalprice / 1000000 * 10 + 0.5) / 10) || 'M' WHEN o_totalprice >= 1000 THEN '$' || format('{:.1f}', floor(o_totalprice / 1000 * 10 + 0.5) / 10) || 'K' ELSE '$' || CAST(trunc(o_totalprice) AS BIGINT) END AS short_money,
    '$' || format('{:,.2f}', o_totalprice) AS long_money FROM orders""",
)
def text_cleanup(t: Tables):
    k = F.col("o_orderkey").cast("string")
    return t.orders.select(
        "o_orderkey",
        F.array_join(text.csv_list(F.concat(F.col("o_orderpriority"), F.lit(", ,x ,"), F.col("o_orderstatus"))), "+").alias("parts"),
        text.company_core(F.concat(F.lit("The Acme Tools (US) "), k, F.lit(" Inc, of Ohio"))).alias("company"),
        text.strip_fences(F.concat(F.lit('```json\n{"a": '), k, F.lit("}\n```"))).alias("fenced"),
        F.contains(F.lit("a.b"), F.lit(".")).alias("literal_dot"),
        text.display_label("o_orderstatus", LABELS).alias("label"),
        text.money_short("o_totalprice").alias("short_money"),
        text.money_grouped("o_totalprice").alias("long_money"),
    )


@query(
    "REG06 REG10 REG12 REG13",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Q' || quarter(o_orderdate) || ' 20' || right(CAST(year(o_orderdate) AS VARCHAR), 2) WHEN o_orderkey % 3 = 1 THEN '2024' ELSE 'Unknown' END AS period,
    'Austin, TX' AS raw_location, 'Chad' AS country, CASE WHEN o_orderkey % 2 = 0 THEN 'labor' END AS department FROM orders""",
)
def hints_and_periods(t: Tables):
    k = F.col("o_orderkey")
    when = F.when(k % 3 == 0, F.concat(F.date_format("o_orderdate", "MMM d"), F.lit(", 20"), F.date_format("o_orderdate", "yy"))).when(k % 3 == 1, "in 2024").otherwise("soon")
    return t.orders.select(
        "o_orderkey",
        text.period(when).alias("period"),
        text.group(F.lit("a role at Austin, TX for nurses"), r"(?:in|at|location[:\s]+)\s*([A-Z][a-z]+(?:,\s*[A-Z]{2})?)").alias("raw_location"),
        title_country(F.lit("Chad - Level 3")).alias("country"),
        text.group(F.lower(F.when(k % 2 == 0, "The Department of Labor said").otherwise("Office")), r"department of (defense|state|homeland|labor|justice|health)").alias("department"),
    )


@query(
    "DAT01 DAT02 DAT06 DAT07",
    """SELECT o_orderkey, o_orderdate + CASE WHEN o_orderkey % 9 = 7 THEN INTERVAL 4 HOUR ELSE INTERVAL 0 HOUR END AS parsed, strftime(o_orderdate - INTERVAL 30 DAY, '%m/%d/%Y') AS window_start, strftime(o_orderdate - INTERVAL 18 MONTH, '%m/%d/%Y') AS long_start, strftime(o_orderdate, '%b %y') AS month_key,
    CASE WHEN d = 0 THEN 'Today' WHEN d = 1 THEN 'Yesterday' WHEN d < 30 THEN d || 'd ago' ELSE strftime(o_orderdate, '%b %-d') END AS age
    FROM (SELECT *, CAST(floor((epoch_us(TIMESTAMP '2001-08-01 12:00:00') - epoch_us(o_orderdate)) / 86400000000) AS BIGINT) AS d FROM orders)""",
)
def date_formats(t: Tables):
    forms = ["MM/dd/yyyy", "yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'", "MMM d, yyyy", "EEEE, MMMM d, yyyy", "d MMM yyyy HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss'-04:00'", "M/d/yyyy h:mm a"]
    kind = F.col("o_orderkey") % len(forms)
    at = F.coalesce(*[F.when(kind == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)])
    return t.orders.select(
        "o_orderkey",
        dates.permissive(at).cast("timestamp_ntz").alias("parsed"),
        F.date_format(F.date_sub("o_orderdate", 30), "MM/dd/yyyy").alias("window_start"),
        F.date_format(F.add_months("o_orderdate", -18), "MM/dd/yyyy").alias("long_start"),
        F.date_format("o_orderdate", "MMM yy").alias("month_key"),
        dates.age_label(dates.stamp("o_orderdate"), dates.moment("2001-08-01 12:00:00")).alias("age"),
    )


@query("PRJ03", "SELECT c_custkey, repeat('*', greatest(0, length(c_name) - 4)) || right(c_name, 4) AS masked, CASE WHEN c_custkey % 2 = 0 THEN 'abc' ELSE '*2345' END AS short FROM customer")
def mask_secret(t: Tables):
    return t.customer.select("c_custkey", text.masked("c_name").alias("masked"), text.masked(F.when(F.col("c_custkey") % 2 == 0, "abc").otherwise("12345")).alias("short"))


SOURCES = {"samGov": "sam_gov", "gemini": "manual", "serper": "manual", "tavily": "manual", "tango": "manual", "bidnet": "manual"}


@query(
    "PRJ02 CLS16",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'sam_gov' ELSE 'manual' END AS source, CASE WHEN o_orderdate < TIMESTAMP '1998-01-01' THEN 'archived' ELSE 'active' END AS status,
    CASE WHEN o_orderkey % 7 = 0 THEN 'low' WHEN s >= 75 THEN 'high' WHEN s >= 50 THEN 'medium' WHEN s IS NOT NULL THEN 'low' END AS confidence,
    CASE WHEN o_orderkey % 7 = 0 THEN 'Web discovery' ELSE nullif(o_orderpriority, '5-LOW') END AS notes, CAST(s AS VARCHAR) AS relevance, c_name AS agency
    FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS INTEGER) END AS s FROM orders) JOIN customer ON c_custkey = o_custkey""",
)
def canonical_record(t: Tables):
    k = F.col("o_orderkey")
    score = F.when(k % 4 == 0, F.lit(None)).otherwise((k % 100).cast("int"))
    fallback = k % 7 == 0
    provider = F.when(k % 2 == 0, "samGov").otherwise("websearch")
    table = F.create_map(*[F.lit(x) for p in SOURCES.items() for x in p])
    rows = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(
        "o_orderkey",
        F.coalesce(F.try_element_at(table, provider), F.lit("manual")).alias("source"),
        F.when(dates.stamp("o_orderdate") < dates.moment("1998-01-01"), "archived").otherwise("active").alias("status"),
        confidence(score, fallback).alias("confidence"),
        F.when(fallback, "Web discovery").otherwise(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("notes"),
        score.cast("string").alias("relevance"),
        F.col("c_name").alias("agency"),
    )


@query(
    "PRJ05 PRJ06 REG01 JOI07",
    f"""SELECT page_id, 'portal-' || substr(sha256(url), 1, 20) AS external_id, CASE WHEN ends_with(h, 'example.net') THEN 'NT Government' ELSE 'Unknown' END AS agency,
    CASE WHEN page_id % 2 = 0 THEN 'archived' ELSE 'active' END AS status, 'low' AS confidence, CASE WHEN page_id % 2 = 0 THEN DATE '2024-03-05' END AS deadline, '{{"url":"' || url || '","portal":' || CASE WHEN ends_with(h, 'example.net') THEN '"NT"' ELSE '"State Portal"' END || '}}' AS raw
    FROM (SELECT *, {HOST_SQL} AS h FROM pages)""",
)
def portal_record(t: Tables):
    portal = F.when(F.contains(text.url_host("url"), F.lit("example.net")), "NT")
    found = text.deadline(F.when(F.col("page_id") % 2 == 0, "Bids due: March 5, 2024").otherwise("no date"))
    rows = t.pages.select("page_id", "url", portal.alias("portal"), found.alias("deadline"))
    return rows.select(
        "page_id",
        text.url_id("url", "portal").alias("external_id"),
        F.coalesce(text.agency(F.lit("plain words")), F.concat(F.col("portal"), F.lit(" Government")), F.lit("Unknown")).alias("agency"),
        F.when(F.col("deadline") < F.lit("2025-01-01").cast("date"), "archived").otherwise("active").alias("status"),
        F.lit("low").alias("confidence"),
        "deadline",
        F.to_json(F.struct("url", F.coalesce("portal", F.lit("State Portal")).alias("portal"))).alias("raw"),
    )


@query(
    "JOI03",
    """SELECT doc_id, sha256(CASE WHEN length(b.text) > 200 THEN substring(b.text, 1, 4000) ELSE coalesce(d.text, '') END) AS content_hash, coalesce(length(b.text) > 200, false) AS enriched
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id""",
)
def text_backfill(t: Tables):
    """A fetched page of more than 200 characters, its first 4000, replaces the snippet."""
    fetched = t.benchmark.select(F.col("item_id").alias("doc_id"), F.col("text").alias("page"))
    good = F.coalesce(F.length("page") > 200, F.lit(False))
    content = F.when(good, F.substring("page", 1, 4000)).otherwise(F.coalesce("text", F.lit("")))
    return t.documents.join(fetched, "doc_id", "left").select("doc_id", F.sha2(content, 256).alias("content_hash"), good.alias("enriched"))


@query("JOI10 FLT07", f"SELECT page_id, d.suffix FROM (SELECT page_id, {HOST_SQL} AS h FROM pages) JOIN (SELECT unnest(['example.org', 'ththly.example.org', 'example.net']) AS suffix) d ON h = d.suffix OR ends_with(h, '.' || d.suffix)")
def host_suffix_join(t: Tables):
    """Every suffix of a host is a key, so this is an equality join."""
    parts = F.split(text.url_host("url"), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    listed = F.explode(F.array(F.lit("example.org"), F.lit("ththly.example.org"), F.lit("example.net")))
    wanted = t.spark.range(1).select(listed.alias("suffix"))
    return t.pages.select("page_id", F.explode(suffixes).alias("suffix")).join(F.broadcast(wanted), "suffix").select("page_id", "suffix")


@query("FLT07 SRC21", f"SELECT {HOST_SQL} AS host, min(page_id) AS first_page, count(*) AS n FROM pages WHERE NOT ends_with({HOST_SQL}, 'example.com') GROUP BY 1")
def search_results(t: Tables):
    results = t.pages.select(F.col("url").alias("link"), "page_id").where(~filters.blocked("link", ["example.com"]))
    return results.groupBy(text.url_host("link").alias("host")).agg(F.min("page_id").alias("first_page"), F.count("*").alias("n"))
