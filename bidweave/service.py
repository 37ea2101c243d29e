"""The reference's routes as functions over tables: reads give DataFrames, writes give the table's new state.

ROUTES maps every route to its function. There is no HTTP layer; parameters are arguments, a missing row is an
empty result, and the present is always ``as_of``. Remote answers come in as tables of results.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.functions import dates, rules, text
from bidweave.operators import dedupe, filters, joins, merge, rollups, scoring
from bidweave.schemas import DOMAINS, TABLES, ordinal
from bidweave.sources import csv_import, registry

ROUTES: dict[str, Callable[..., object]] = {}


def route(*names: str):
    def add(function):
        for name in names:
            ROUTES[name] = function
        return function

    return add


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def new_id() -> Column:
    return F.expr("uuid()")


def shaped(df: DataFrame, table: str, as_of: Column) -> DataFrame:
    """Rows in the shape of a table: missing columns are null, times of writing are ``as_of``."""
    now = as_of.cast("timestamp_ntz")
    values = {f.name: F.col(f.name).cast(f.dataType) if f.name in df.columns else now if f.name in ("created_at", "updated_at", "fetched_at") else F.lit(None).cast(f.dataType) for f in TABLES[table]}
    return df.select(*[v.alias(k) for k, v in values.items()])


#: Fixed value: the note that is stored with a find that no model has read yet.
FALLBACK_NOTE = "Web discovery — AI analysis pending (rate limited). Review source URL for details."


@route("GET /healthz")
def health(spark: SparkSession) -> DataFrame:
    return registry.inline(spark, "status string", [("ok",)])


# --- one table: list, create, patch, delete -------------------------------------------------------


@route("GET /competitors", "GET /prospects")
def listed_by_name(table: DataFrame) -> DataFrame:
    return table.orderBy("name")


@route("GET /opportunities/:id")
def by_id(table: DataFrame, key: str) -> DataFrame:
    return table.where(F.col("id") == key)


@route("POST /competitors", "POST /prospects")
def created(table: DataFrame, rows: DataFrame, name: str, as_of: Column, defaults: dict[str, str] | None = None) -> DataFrame:
    """Trimmed texts, blanks as null, defaults; a row without a name isn't created."""
    texts = [f.name for f in rows.schema if f.dataType.simpleString() == "string" and f.name != "id"]
    ready = merge.prepared(rows, texts, defaults).where("name is not null")
    return table.unionByName(shaped(ready if "id" in ready.columns else ready.withColumn("id", new_id()), name, as_of))


@route("PATCH /competitors/:id", "PATCH /prospects/:id", "PATCH /federal-intel/:bucket/:id")
def patched(table: DataFrame, patch: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """The new state and the changed rows; updated_at moves for them."""
    touched = patch.select("id").withColumn("_t", F.lit(True))
    state = merge.patched(table, patch, "id").join(touched, "id", "left")
    state = state.withColumn("updated_at", F.when(F.col("_t"), as_of.cast("timestamp_ntz")).otherwise(F.col("updated_at")))
    return state.drop("_t").select(*table.columns), state.where("_t").select(*table.columns)


@route("DELETE /opportunities/:id", "DELETE /competitors/:id", "DELETE /prospects/:id", "DELETE /prospects/:id/contacts/:cid", "DELETE /clients/:id/contacts/:cid", "DELETE /state-agencies/:state/items")
def deleted(table: DataFrame, **keys: str | None) -> DataFrame:
    """Rows that match all given keys go; keys without a value don't restrict."""
    found = F.lit(True)
    for column, wanted in keys.items():
        if wanted is not None:
            found = found & (F.col(column) == wanted)
    return merge.deleted(table, found)


# --- opportunities --------------------------------------------------------------------------------


def archived(opportunities: DataFrame, as_of: Column) -> DataFrame:
    due = F.coalesce((F.col("status") == "active") & (F.col("response_deadline") < as_of.cast("timestamp_ntz")), F.lit(False))
    return opportunities.withColumns({"status": F.when(due, "archived").otherwise(F.col("status")), "updated_at": F.when(due, as_of.cast("timestamp_ntz")).otherwise(F.col("updated_at"))})


@route("GET /opportunities")
def list_opportunities(opportunities: DataFrame, as_of: Column, search: str | None = None, status: str | None = None, kind: str | None = None, source: str | None = None, provider: str | None = None, page: int = 1, limit: int = 50) -> DataFrame:
    rows = filters.matching(
        archived(opportunities, as_of),
        filters.any_ilike(search, "title", "agency", "description", "solicitation_number"),
        filters.equals("status", status),
        filters.equals("type", kind),
        filters.equals("source", source),
        F.ilike(F.col("provider_name"), F.lit(provider)) if provider and provider != "all" else None,
    )
    out = filters.page(rows, [F.desc_nulls_first("posted_date"), F.asc("id")], page, limit)
    numbers = ["estimated_value", "ceiling_value", "floor_value", "award_amount", "relevance_score"]
    return out.withColumns({c: F.col(c).cast("double") for c in numbers}).withColumn("pages", F.ceil(F.col("total") / F.lit(min(200, limit if limit > 0 else 50))))


@route("POST /opportunities/fetch")
def fetched(opportunities: DataFrame, canonical: DataFrame, as_of: Column, keywords: list[str] | None = None, codes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical records scored, reduced to the last writer of each notice and merged; with run statistics."""
    body = text.joined("title", "description", "agency")
    score, _ = scoring.opportunity(F.col("status"), dates.stamp("response_deadline"), F.col("naics_code"), F.col("description"), F.col("source_url"), F.col("set_aside"), body, as_of, codes or [], keywords or [], [])
    ranked = canonical.withColumns({"_score": score, "_at": F.monotonically_increasing_id()})
    named = dedupe.last_writer(ranked.where("external_id <> ''"), "external_id", "_score", "_at")
    rows = named.unionByName(ranked.where("external_id is null or external_id = ''"))
    table = F.create_map(*[F.lit(x) for p in {"samGov": "sam_gov", "gemini": "manual", "serper": "manual", "tavily": "manual", "tango": "manual", "bidnet": "manual"}.items() for x in p])
    relevance = F.get_json_object("raw_data", "$.relevanceScore").try_cast("double")
    fallback = F.coalesce(F.get_json_object("raw_data", "$.fallback") == "true", F.lit(False))
    expired = F.coalesce(dates.stamp("response_deadline") < as_of, F.lit(False))
    records = rows.select(
        F.nullif("external_id", F.lit("")).alias("notice_id"),
        "title", "agency", "sub_agency", "type",
        F.when(expired, "archived").otherwise(F.col("status")).alias("status"),
        "naics_code", "naics_description", "posted_date", "response_deadline", "set_aside", "place_of_performance", "description", "solicitation_number",
        F.col("source_url").alias("sam_url"), "estimated_value", "award_amount", "awardee",
        F.coalesce(F.try_element_at(table, F.col("source")), F.lit("manual")).alias("source"),
        F.col("source").alias("provider_name"),
        relevance.cast("decimal(38,6)").alias("relevance_score"),
        rules.confidence(relevance, fallback).alias("source_confidence"),
        F.when(fallback, FALLBACK_NOTE).otherwise(F.get_json_object("raw_data", "$.relevanceReason")).alias("notes"),
    ).withColumn("id", new_id())
    incoming = shaped(records, "opportunities", as_of)
    keyed = incoming.where("notice_id is not null")
    state = merge.upserted(opportunities.where("notice_id is not null"), keyed, "notice_id", keep=["created_at"])
    out = state.select(*opportunities.columns).unionByName(opportunities.where("notice_id is null")).unionByName(incoming.where("notice_id is null"))
    known = keyed.join(opportunities.select("notice_id"), "notice_id", "left_semi").agg(F.count("*").alias("n")).scalar()
    stats = canonical.agg(F.count("*").alias("fetched")).withColumns({"_kept": incoming.agg(F.count("*").alias("n")).scalar(), "updated": known})
    return out, stats.select("fetched", (F.col("_kept") - F.col("updated")).alias("created"), "updated", (F.col("fetched") - F.col("_kept")).alias("skipped"))


@route("POST /opportunities/import")
def imported(opportunities: DataFrame, rows: DataFrame, line: str, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The new state, the rejected rows and (imported, skipped)."""
    good, bad = csv_import.to_records(rows, line, as_of)
    fresh = csv_import.new_notices(good, opportunities)
    counts = fresh.agg(F.count("*").alias("imported")).withColumn("skipped", rows.agg(F.count("*").alias("n")).scalar() - F.col("imported"))
    return opportunities.unionByName(shaped(fresh.withColumn("id", new_id()), "opportunities", as_of)), bad, counts


@route("POST /opportunities/enrich")
def enriched(opportunities: DataFrame, pages: DataFrame, as_of: Column, first: int = 100) -> DataFrame:
    """Fills deadline, value and agency of the first rows that lack one, from page texts (url, text)."""
    lacking = opportunities.where(F.col("response_deadline").isNull() | F.col("estimated_value").isNull() | (F.col("agency") == "Unknown")).orderBy("id").limit(first)
    read = lacking.select("id", "title", "description", F.col("sam_url").alias("url")).join(pages.withColumnRenamed("text", "_page"), "url", "left")
    body = F.concat_ws(" ", "title", F.coalesce(F.when(F.length("_page") > 200, F.substring("_page", 1, 4000)), F.col("description")))
    found = read.select("id", text.deadline(body).cast("timestamp_ntz").alias("response_deadline"), text.estimated_value(body).cast("decimal(38,6)").alias("estimated_value"), text.agency(body).alias("agency"))
    return archived(merge.backfilled(opportunities, found, "id", ["response_deadline", "estimated_value", "agency"], {"agency": "Unknown"}), as_of)


# --- settings and providers -----------------------------------------------------------------------


@route("GET /settings")
def masked_settings(settings: DataFrame) -> DataFrame:
    return settings.select("key", text.masked("value").alias("value"))


@route("PUT /settings", "PUT /providers/:name")
def put_settings(settings: DataFrame, change: DataFrame, arrival: str) -> DataFrame:
    return merge.upserted(settings, merge.last_values(change, "key", arrival).select("key", "value"), "key")


@route("GET /providers")
def provider_status(providers: DataFrame, settings: DataFrame, environment: DataFrame, opportunities: DataFrame) -> DataFrame:
    """providers: (name, key). Configured where the key has a value; with the number of their records."""
    values = registry.setting(settings, environment)
    counts = opportunities.groupBy(F.col("provider_name").alias("name")).agg(F.count("*").alias("n"))
    return registry.provider_status(providers.join(values, "key", "left"), counts, "name").select("name", F.col("value").isNotNull().alias("configured"), "n")


# --- research: search results to facts ------------------------------------------------------------


def _said(results: DataFrame) -> Column:
    return text.joined("title", "content")


@route("POST /competitors/:id/research")
def contract_wins(results: DataFrame, first: int = 10) -> DataFrame:
    """results: (key, pos, title, content, url). The first wins of each key, with value, date and agency."""
    rows = dedupe.first_k(results.where(text.has_any(_said(results), rules.WIN_WORDS)), ["key"], [F.asc("pos")], first)
    value = text.group(F.col("content"), r"(?i)(\$[\d,]+(?:\.\d+)?(?:\s*(?:million|billion|M|B))?)")
    return rows.select(
        "key", "pos", F.substring("title", 1, 120).alias("title"),
        F.coalesce(F.nullif(text.trimmed(F.regexp_extract("title", r"^([^|–-]+)\s*[|–-]", 1)), F.lit("")), F.lit("Government Agency")).alias("agency"),
        F.coalesce(value, F.lit("")).alias("value"), F.regexp_extract("content", text.WIN_DATE, 0).alias("date"), "url",
    )


@route("POST /prospects/:id/research")
def opportunity_signals(results: DataFrame, first: int = 10) -> DataFrame:
    rows = results.withColumn("type", rules.classify(_said(results), rules.SIGNAL_TYPE)).where("type is not null")
    return dedupe.first_k(rows, ["key"], [F.asc("pos")], first).select("key", "pos", F.substring("title", 1, 120).alias("title"), "type", F.regexp_extract("content", text.WIN_DATE, 0).alias("date"), "url")


def places(results: DataFrame, kinds: rules.Rules, first: int = 60) -> DataFrame:
    """Locations (key, city, state, country, type) that results mention; one per city and country, the first counts."""
    rows = results.select("key", "pos", F.concat_ws(" ", "title", "content").alias("s"))
    us = F.transform(
        F.regexp_extract_all("s", F.lit(r"\b[A-Z][a-z]+(?:\s[A-Z][a-z]+)?,\s*[A-Z]{2}\b"), F.lit(0)),
        lambda m: F.struct(F.regexp_extract(m, "^(.*),", 1).alias("city"), F.right(m, F.lit(2)).alias("state"), F.lit("United States").alias("country")),
    )
    us = F.filter(us, lambda p: p["state"].isin(registry.STATE_CODES))
    abroad = F.array_compact(F.array(*[F.when(F.contains("s", F.lit(c)), F.struct(F.regexp_extract("s", rf"([A-Z][a-z]+(?:\s[A-Z][a-z]+)?)\s*,?\s*{c}", 1).alias("city"), F.lit("").alias("state"), F.lit(c).alias("country"))) for c in registry.COUNTRIES]))
    flat = rows.select("key", "pos", rules.classify(F.lower("s"), kinds, "office").alias("type"), F.posexplode(F.concat(us, abroad)).alias("n", "p")).select("key", "pos", "n", "type", "p.*")
    keyed = flat.withColumn("_k", F.concat_ws("|", F.lower("city"), F.lower("country")))
    unique = dedupe.best_by(keyed, ["key", "_k"], ["pos", "n"])
    return dedupe.first_k(unique.withColumnRenamed("pos", "seen"), ["key"], [F.asc("seen"), F.asc("n")], first).select("key", F.nullif("city", F.lit("")).alias("city"), "state", "country", "type")


@route("POST /prospects/:id/locations/discover")
def discover_locations(locations: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    found = places(results, rules.LOCATION_TYPE).select(F.col("key").alias("prospect_id"), "city", "state", "country", "type", F.concat_ws("|", F.lower(F.coalesce("city", F.lit(""))), F.lower("country")).alias("_k"))
    have = locations.select("prospect_id", F.concat_ws("|", F.lower(F.coalesce("city", F.lit(""))), F.lower("country")).alias("_k"))
    fresh = joins.without_existing(found, have, ["prospect_id", "_k"]).withColumns({"id": new_id(), "open_positions": F.lit(0), "health_positions": F.lit(0)})
    return locations.unionByName(shaped(fresh, "prospect_locations", as_of))


@route("POST /clients/:id/research-branches")
def discover_branches(branches: DataFrame, results: DataFrame, as_of: Column) -> DataFrame:
    found = places(results, rules.BRANCH_TYPE).select(F.col("key").alias("client_id"), "city", "state", "country", F.col("type").alias("branch_type"), F.concat_ws("|", F.lower(F.coalesce("city", F.lit(""))), F.lower("country")).alias("_k"))
    have = branches.select("client_id", F.concat_ws("|", F.lower(F.coalesce("city", F.lit(""))), F.lower("country")).alias("_k"))
    fresh = joins.without_existing(found, have, ["client_id", "_k"]).withColumns({"id": new_id(), "hiring_trend_direction": F.lit("unknown"), "posting_count": F.lit("0")})
    return branches.unionByName(shaped(fresh, "client_branches", as_of))


# --- prospects: locations, jobs -------------------------------------------------------------------


@route("GET /prospects/:id/locations")
def prospect_locations(locations: DataFrame, prospect: str) -> DataFrame:
    return locations.where(F.col("prospect_id") == prospect).orderBy(F.asc_nulls_last("country"), F.asc_nulls_last("city"))


@route("GET /prospects/:id/jobs")
def prospect_jobs(jobs: DataFrame, prospect: str) -> DataFrame:
    return jobs.where(F.col("prospect_id") == prospect).orderBy("title")


@route("POST /prospects/:id/jobs/discover")
def discover_jobs(jobs: DataFrame, locations: DataFrame, results: DataFrame, prospect: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Replaces a prospect's jobs by postings (title, content, url) and writes their counts onto its locations."""
    own = locations.where(F.col("prospect_id") == prospect)
    order = own.select("id", F.coalesce("city", F.lit("")).alias("city"), F.coalesce("state", F.lit("")).alias("state"), F.col("id").alias("ordinal"))
    placed = joins.contained_place(results.withColumn("_t", text.joined("title", "content")), "_t", order)
    t = F.col("_t")
    reason = text.first_found(t, rules.HEALTH_KEYWORDS)
    rows = placed.select(
        new_id().alias("id"), F.lit(prospect).alias("prospect_id"), F.col("place_id").alias("location_id"), text.job_title("title").alias("title"),
        F.when(reason.isNotNull(), "Health & Safety").otherwise(rules.classify(t, rules.JOB_DEPARTMENT, "General")).alias("department"),
        F.regexp_extract("content", r"(?:in|at|location[:\s]+)\s*([A-Z][a-z]+(?:,\s*[A-Z]{2})?)", 1).alias("raw_location"),
        rules.classify(t, rules.JOB_TYPE, "full-time").alias("job_type"), F.regexp_extract("content", text.RELATIVE_DATE, 0).alias("posted_date"), "url",
        F.substring("content", 1, 400).alias("snippet"), reason.isNotNull().alias("is_health_related"), F.coalesce(reason, F.lit("")).alias("health_relevance_reason"),
    )
    fresh = shaped(rows, "prospect_jobs", as_of)
    rolled = rollups.nested_counts(rows.where("location_id is not null"), "location_id", "department", F.col("is_health_related"))
    stats = rolled.select(F.col("location_id").alias("id"), F.col("total").cast("int").alias("open_positions"), F.col("flagged").cast("int").alias("health_positions"), rules.hiring_level(F.col("total")).alias("hiring_trend"), F.to_json("categories").alias("hiring_categories"))
    return merge.deleted(jobs, F.col("prospect_id") == prospect).unionByName(fresh), merge.written_back(locations, stats, "id", ["open_positions", "health_positions", "hiring_trend", "hiring_categories"])


@route("DELETE /prospects/:id/locations/:lid")
def delete_location(locations: DataFrame, jobs: DataFrame, location: str) -> tuple[DataFrame, DataFrame]:
    return merge.cascaded(locations, jobs, locations.where(F.col("id") == location), "id", "location_id")


# --- contacts -------------------------------------------------------------------------------------


@route("GET /prospects/:id/contacts", "GET /clients/:id/contacts")
def contacts(table: DataFrame, foreign: str, key: str) -> DataFrame:
    return table.where(F.col(foreign) == key).orderBy(ordinal(F.col("category"), DOMAINS["contact_category"]), "name")


@route("POST /prospects/:id/contacts", "POST /clients/:id/contacts", "POST /prospects/:id/contacts/bulk", "POST /clients/:id/contacts/bulk")
def add_contacts(table: DataFrame, rows: DataFrame, name: str, as_of: Column, bulk: bool = False, replace: str | None = None) -> DataFrame:
    """rows: (owner, name, category_raw, title, ...). One by one, flags look at the resolved category, in bulk at the raw one.

    ``replace`` names an owner whose contacts go first."""
    client = name == "client_contacts"
    foreign = "client_id" if client else "prospect_id"
    raw = F.coalesce("category_raw", F.lit(""))
    mapped = rules.client_contact(raw) if client else rules.classify(F.lower(raw), rules.PROSPECT_CONTACT, "other")
    category = F.when(raw.isin(DOMAINS["contact_category"]), raw).otherwise(mapped)
    ready = rows.withColumns({"category": category, "_raw": raw})
    ehs = text.has_any(text.joined("_raw" if bulk else "category", F.coalesce("title", F.lit(""))), rules.CLIENT_EHS_WORDS if client else rules.EHS_WORDS)
    ready = ready.withColumns({"is_ehs_contact": ehs, "id": new_id(), foreign: F.col("owner")}).withColumn("is_key_contact", F.col("is_ehs_contact") | F.col("category").isin(rules.KEY_CATEGORIES))
    state = merge.deleted(table, F.col(foreign) == replace) if replace else table
    return state.unionByName(shaped(ready, name, as_of))


# --- clients --------------------------------------------------------------------------------------


@route("GET /clients")
def clients_with_counts(clients: DataFrame, branches: DataFrame) -> DataFrame:
    return rollups.counted(clients, branches, "id", "client_id", "branch_count").orderBy("name")


@route("GET /clients/:id", "GET /clients/:id/hiring")
def client_bundle(clients: DataFrame, branches: DataFrame, posts: DataFrame, client: str) -> DataFrame:
    """A client with its branches and their postings."""
    value = F.struct(F.coalesce("country", F.lit("~")).alias("country"), F.coalesce("city", F.lit("~")).alias("city"), "id", "hiring_trend_direction", "posting_count")
    post = F.struct("branch_id", "title", "url")
    return rollups.bundled(clients.where(F.col("id") == client), "id", [("branches", branches.where(F.col("client_id") == client), "client_id", value), ("posts", posts.where(F.col("client_id") == client), "client_id", post)])


@route("POST /clients/:id/branches/:bid/refresh-hiring")
def refresh_hiring(clients: DataFrame, branches: DataFrame, posts: DataFrame, results: DataFrame, client: str, branch: str, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Replaces a branch's postings (title, content, url), then its trend, then the client's."""
    t = text.joined("title", "content")
    rows = results.select(
        new_id().alias("id"), F.lit(branch).alias("branch_id"), F.lit(client).alias("client_id"), text.job_title("title").alias("title"), rules.classify(t, rules.BRANCH_DEPARTMENT, "General").alias("department"), "url",
        F.regexp_extract("content", text.RELATIVE_DATE, 0).alias("posted_date"), rules.classify(F.col("url"), rules.POSTING_SITE, "Web").alias("source"), F.to_json(F.struct("title", F.col("content").alias("snippet"), F.col("url").alias("link"))).alias("raw_json"),
    )
    new_posts = merge.deleted(posts, F.col("branch_id") == branch).unionByName(shaped(rows, "branch_hiring_posts", as_of))
    n = results.agg(F.count("*").alias("n"))
    trend = n.select(F.lit(branch).alias("id"), rules.hiring_sentence(F.col("n")).alias("hiring_trend_summary"), rules.hiring_trend(F.col("n")).alias("hiring_trend_direction"), F.col("n").cast("string").alias("posting_count"))
    new_branches = merge.written_back(branches, trend, "id", ["hiring_trend_summary", "hiring_trend_direction", "posting_count"])
    overall = rollups.majority_trend(new_branches.where(F.col("client_id") == client), "client_id", "hiring_trend_direction").select(F.col("client_id").alias("id"), F.col("trend").alias("overall_hiring_trend"))
    return merge.written_back(clients, overall, "id", ["overall_hiring_trend"]), new_branches, new_posts


@route("GET /clients/:id/intelligence/summary")
def intelligence_summary(parts: DataFrame) -> DataFrame:
    """parts: (client, kind, total); a failed part is null and counts as 0."""
    return parts.groupBy("client").pivot("kind", ["fec", "osha", "litigation"]).agg(F.sum(F.coalesce("total", F.lit(0)))).na.fill(0)


@route("GET /clients/:id/intelligence/fec")
def party_split(disbursements: DataFrame) -> DataFrame:
    return rollups.percent_split(disbursements, rules.classify(F.lower(F.coalesce("recipient", F.lit(""))), rules.PARTY, "Other / Bipartisan"), F.col("amount"), "party")


@route("GET /clients/:id/intelligence/osha")
def enforcement(results: DataFrame, first: int = 20) -> DataFrame:
    """results: (pos, title, content, url)."""
    official = F.contains("url", F.lit("osha.gov"))
    kept = results.where(official | F.concat_ws(" ", "title", "content").rlike(r"(?i)\b(osha|inspection|violation|penalty|citation|willful|serious|recordable|fatality|illness|safety|health)\b"))
    rows = filters.first_rows(dedupe.first_seen(kept, "url", ["pos"]).withColumnRenamed("pos", "seen"), F.lit(True), [F.asc("seen")], first)
    return rows.select(
        F.concat(F.lit("serper-"), (F.col("pos") - 1).cast("string")).alias("id"), "title",
        F.regexp_replace(text.group(F.col("content"), r"(\$[\d,]+(?:\.\d{2})?)"), "[$,]", "").alias("total_penalty"),
        text.group(F.col("content"), r"(?i)(\d+)\s+(?:serious\s+)?violation").try_cast("int").alias("violations"),
        F.coalesce(text.group(F.col("content"), r"\b([A-Z]{2})\b"), text.group(F.col("url"), r"(?i)state=([A-Z]{2})")).alias("state"), "url", official.alias("official"),
    )


@route("GET /clients/:id/intelligence/litigation")
def litigation(cases: DataFrame) -> DataFrame:
    """cases: (docket, case_name, filed, terminated)."""
    return cases.select("docket", "case_name", "filed", F.when(F.col("terminated").isNull(), "Active").otherwise("Closed").alias("status"))


# --- federal and state items ----------------------------------------------------------------------


@route("GET /federal-intel/:bucket")
def bucket_page(items: DataFrame, bucket: str, page: int = 1, limit: int = 50) -> DataFrame:
    if bucket not in DOMAINS["federal_bucket"]:
        raise ValueError(f"no bucket {bucket!r}")
    return filters.page(items.where(F.col("bucket") == bucket), [F.desc_nulls_first("fetched_at"), F.asc("id")], max(1, page), min(200, max(1, limit)))


@route("POST /federal-intel/:bucket/refresh")
def refresh_bucket(items: DataFrame, fresh: DataFrame, bucket: str, as_of: Column) -> DataFrame:
    """Items get ids from their url, reference or title; values that come win unless null, tags and creation stay."""
    rows = fresh.withColumns({"id": text.item_id(F.lit(bucket), "source_url", "related_ref", "title"), "bucket": F.lit(bucket), "occu_med_score": F.coalesce("occu_med_score", F.lit(0)), "_at": F.monotonically_increasing_id()})
    unique = dedupe.best_by(rows, ["id"], [-F.col("_at")]).drop("_at")
    return merge.upserted(items, shaped(unique, "federal_intel_items", as_of), "id", keep=["action_tag", "created_at"])


@route("GET /state-agencies")
def states_with_counts(profiles: DataFrame, items: DataFrame) -> DataFrame:
    return rollups.counted(profiles, items, "state_code", "state_code", "item_count").orderBy("state_name")


@route("GET /state-agencies/:state/items")
def state_items(items: DataFrame, state: str, bucket: str | None = None) -> DataFrame:
    return filters.matching(items, filters.equals("state_code", state), filters.equals("bucket", bucket)).orderBy(F.asc_nulls_last("relevance_score"), F.asc_nulls_last("fetched_at"))


@route("POST /state-agencies/:state/refresh")
def refresh_state(items: DataFrame, profiles: DataFrame, results: DataFrame, state: str, bucket: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Replaces a (state, bucket) by search results (pos, title, content, url) and notes the time on the profile."""
    unique = dedupe.first_seen(results, "url", ["pos"])
    t = text.joined("title", "content")
    rows = unique.select(
        new_id().alias("id"), F.lit(state).alias("state_code"), F.lit(bucket).alias("bucket"), F.substring("title", 1, 255).alias("title"), F.substring("content", 1, 500).alias("summary"), "url",
        F.coalesce(text.url_host("url"), F.substring("url", 1, 50)).alias("agency"), rules.classify(t, rules.ITEM_TYPE, "news").alias("item_type"), scoring.keyword_relevance(t).alias("relevance_score"),
    )
    touched = registry.inline(results.sparkSession, "state_code string, bucket string", [(state, bucket)])
    new_items = merge.replaced_partitions(items, shaped(rows, "state_agency_items", as_of), ["state_code", "bucket"], touched).select(*items.columns)
    old = F.coalesce(F.from_json("last_refreshed", "map<string,string>"), F.create_map().cast("map<string,string>"))
    stamped = F.to_json(merge.set_key(old, F.lit(bucket), F.date_format(as_of, "yyyy-MM-dd'T'HH:mm:ss")))
    return new_items, profiles.withColumn("last_refreshed", F.when(F.col("state_code") == state, stamped).otherwise(F.col("last_refreshed")))


@route("GET /state-agencies/intel")
def intel_counts(intel: DataFrame) -> DataFrame:
    return intel.groupBy("channel").agg(F.count("*").alias("n"))


@route("POST /state-agencies/intel/refresh")
def refresh_intel(intel: DataFrame, results: DataFrame, supplement: DataFrame, channel: str, as_of: Column, least: int = 5) -> DataFrame:
    """Replaces a channel by results, with the supplement where they are fewer than ``least``."""
    rows = filters.with_fallback(dedupe.first_seen(results, "url", ["pos"]), supplement, least)
    t = text.joined("title", "content")
    fresh = rows.select(new_id().alias("id"), F.lit(channel).alias("channel"), "title", F.col("content").alias("summary"), "url", F.coalesce(text.url_host("url"), F.substring("url", 1, 50)).alias("source"), rules.classify(t, rules.SEVERITY, "low").alias("severity"))
    return merge.deleted(intel, F.col("channel") == channel).unionByName(shaped(fresh, "state_intel_items", as_of))
