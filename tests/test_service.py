"""Routes on tables made by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidweave import service
from bidweave.schemas import CANONICAL, TABLES
from bidweave.sources import registry

NOW = dt.datetime(2025, 6, 1, 12)


@pytest.fixture(scope="module")
def as_of():
    return F.lit("2025-06-01 12:00:00").cast("timestamp")


def table(spark, name, *rows):
    """Rows given by name; other columns are null, required ones get a filler."""
    fill = {"string": "", "timestamp_ntz": dt.datetime(2025, 1, 1)}
    data = [tuple(r.get(f.name, None if f.nullable else fill[f.dataType.simpleString()]) for f in TABLES[name]) for r in rows]
    return spark.createDataFrame(data, TABLES[name])


def results(spark, *rows):
    return spark.createDataFrame([(k, i, t, c, u) for i, (k, t, c, u) in enumerate(rows)], "key string, pos int, title string, content string, url string")


def test_every_resource_has_its_routes():
    assert len(service.ROUTES) == 52


def test_list_archives_and_pages(spark, as_of):
    ops = table(spark, "opportunities", {"id": "a", "title": "Nurse RFP", "status": "active", "response_deadline": dt.datetime(2025, 1, 1), "posted_date": dt.datetime(2025, 1, 1)}, {"id": "b", "title": "nurse bid", "status": "active", "posted_date": dt.datetime(2025, 2, 1)}, {"id": "c", "title": "other", "status": "active"})
    rows = service.list_opportunities(ops, as_of, search="NURSE", limit=1).collect()
    assert [(r["id"], r["total"], r["pages"]) for r in rows] == [("b", 2, 2)]
    assert service.list_opportunities(ops, as_of, status="archived").first()["id"] == "a"


def test_fetch_merges_by_notice(spark, as_of):
    ops = table(spark, "opportunities", {"id": "x", "notice_id": "n1", "title": "old", "description": "kept", "source": "manual"})
    base = dict.fromkeys(CANONICAL.fieldNames())
    rows = [base | {"external_id": "n1", "title": "new", "agency": "A", "type": "T", "status": "active", "source": "samGov", "posted_date": NOW, "raw_data": '{"relevanceScore": 80}'}, base | {"external_id": "n2", "title": "t", "agency": "A", "type": "T", "status": "active", "source": "you", "posted_date": NOW, "response_deadline": dt.datetime(2025, 1, 1)}, base | {"external_id": "n2", "title": "low", "agency": "A", "type": "T", "status": "archived", "source": "you", "posted_date": NOW}]
    state, stats = service.fetched(ops, spark.createDataFrame([tuple(r.values()) for r in rows], CANONICAL), as_of)
    out = {r["notice_id"]: r for r in state.collect()}
    assert (out["n1"]["title"], out["n1"]["description"], out["n1"]["source"], out["n1"]["source_confidence"]) == ("new", "kept", "sam_gov", "high")
    assert out["n2"]["title"] == "low" and out["n2"]["source"] == "manual"
    assert tuple(stats.first()) == (3, 1, 1, 1)


def test_create_patch_delete(spark, as_of):
    none = service.empty(spark, "competitors")
    rows = spark.createDataFrame([("c1", " Acme ", " ", None), ("c2", "  ", "x", "local")], "id string, name string, notes string, tier string")
    state = service.created(none, rows, "competitors", as_of, {"tier": "regional"})
    assert [(r["id"], r["name"], r["notes"], r["tier"]) for r in state.collect()] == [("c1", "Acme", None, "regional")]
    patch = spark.createDataFrame([("c1", "n", True)], "id string, notes string, has_notes boolean")
    new, changed = service.patched(state, patch, F.lit("2026-01-01").cast("timestamp"))
    assert changed.first()["notes"] == "n" and changed.first()["updated_at"] == dt.datetime(2026, 1, 1)
    assert service.deleted(new, id="c1").count() == 0 and service.deleted(new, id="zz").count() == 1


def test_enrich_fills_only_what_lacks(spark, as_of):
    ops = table(spark, "opportunities", {"id": "a", "title": "t", "agency": "Unknown", "status": "active", "sam_url": "u"}, {"id": "b", "title": "t", "agency": "Own", "estimated_value": None, "status": "active", "response_deadline": dt.datetime(2030, 1, 1)})
    pages = spark.createDataFrame([("u", "City of Austin RFP. Proposals due: April 15, 2024, worth $1.5 million " + "." * 200)], "url string, text string")
    out = {r["id"]: r for r in service.enriched(ops, pages, as_of).collect()}
    assert (out["a"]["agency"], out["a"]["status"], float(out["a"]["estimated_value"]), out["a"]["filled"]) == ("Austin", "archived", 1.5e6, 3)
    assert (out["b"]["agency"], out["b"]["filled"]) == ("Own", 0)


def test_research(spark):
    rows = results(spark, ("k", "Navy - award", "signed for $2.5 million on Mar 3, 2024", "u1"), ("k", "weather", "sunny", "u2"), ("k", "clinic opening", "new facility", "u3"))
    assert [(r["agency"], r["value"], r["date"]) for r in service.contract_wins(rows).collect()] == [("Navy", "$2.5 million", "Mar 3, 2024")]
    assert [r["type"] for r in service.opportunity_signals(rows).orderBy("pos").collect()] == ["Contract Award", "Expansion"]


def test_discovery_of_places_and_jobs(spark, as_of):
    found = results(spark, ("p", "Plant in Reno, NV", "also Lyon, France", "u"), ("p", "HQ", "Reno, NV again; Nowhere, ZZ", "u"))
    locations = service.discover_locations(service.empty(spark, "prospect_locations"), found, as_of)
    assert sorted((r["city"], r["country"], r["type"]) for r in locations.collect()) == [("Lyon", "France", "manufacturing"), ("Reno", "United States", "manufacturing")]
    again = service.discover_locations(table(spark, "prospect_locations", {"id": "l1", "prospect_id": "p", "city": "RENO", "country": "United States"}), found, as_of)
    assert again.count() == 2
    own = table(spark, "prospect_locations", {"id": "l1", "prospect_id": "p", "city": "Reno", "state": "NV", "country": "United States", "open_positions": 0}, {"id": "l2", "prospect_id": "p", "city": "Ajo", "country": "United States", "open_positions": 7})
    jobs, places = service.discover_jobs(service.empty(spark, "prospect_jobs"), own, results(spark, ("p", "Safety officer - day", "at Reno, 2 days ago", "u"), ("p", "Engineer", "in reno", "v")), "p", as_of)
    assert sorted((r["title"], r["department"], r["location_id"], r["posted_date"]) for r in jobs.collect()) == [("Engineer", "Engineering", "l1", ""), ("Safety officer", "Health & Safety", "l1", "2 days ago")]
    out = {r["id"]: (r["open_positions"], r["health_positions"], r["hiring_trend"]) for r in places.collect()}
    assert out == {"l1": (2, 1, "low"), "l2": (7, None, None)}
    left, gone = service.delete_location(own, jobs.where("location_id = 'l1'"), "l2")
    assert left.count() == 1 and gone.columns == jobs.columns


def test_contacts(spark, as_of):
    rows = spark.createDataFrame([("c", "Ann", "Treasurer", "EHS lead"), ("c", "Bob", "legal_compliance", None), ("c", "Cy", "medical facility", "x")], "owner string, name string, category_raw string, title string")
    one = service.add_contacts(service.empty(spark, "client_contacts"), rows, "client_contacts", as_of)
    assert [(r["name"], r["category"], r["is_ehs_contact"], r["is_key_contact"]) for r in service.contacts(one, "client_id", "c").collect()] == [("Ann", "finance", True, True), ("Bob", "legal_compliance", False, False), ("Cy", "ehs_safety", True, True)]
    assert service.add_contacts(one, rows.limit(1), "client_contacts", as_of, bulk=True, replace="c").count() == 1


def test_hiring_moves_branch_and_client(spark, as_of):
    clients = table(spark, "clients", {"id": "c", "name": "n", "overall_hiring_trend": "unknown"})
    branches = table(spark, "client_branches", {"id": "b1", "client_id": "c", "hiring_trend_direction": "unknown"}, {"id": "b2", "client_id": "c", "hiring_trend_direction": "unknown"})
    c, b, p = service.refresh_hiring(clients, branches, service.empty(spark, "branch_hiring_posts"), results(spark, *[("b1", f"Job {i} - x", "now", "https://indeed.com/") for i in range(11)]), "c", "b1", as_of)
    assert c.first()["overall_hiring_trend"] == "growing"
    assert {r["id"]: r["posting_count"] for r in b.collect()} == {"b1": "11", "b2": None}
    assert p.count() == 11 and p.first()["source"] == "Indeed"
    bundle = service.client_bundle(c, b, p, "c").first()
    assert len(bundle["branches"]) == 2 and len(bundle["posts"]) == 11
    assert service.clients_with_counts(c, b).first()["branch_count"] == 2


def test_intelligence(spark):
    out = service.party_split(spark.createDataFrame([("RNC", 30.0), ("dnc", 10.0), ("x", None)], "recipient string, amount double"))
    assert sorted((r["party"], r["pct"]) for r in out.collect()) == [("Democrat", 25), ("Republican", 75)]
    rows = service.enforcement(results(spark, ("k", "OSHA fine", "$1,200.50 and 3 serious violations in TX", "u1"), ("k", "sport", "ball", "u2"), ("k", "again", "safety", "u1")).drop("key")).collect()
    assert [(r["id"], r["total_penalty"], r["violations"], r["state"]) for r in rows] == [("serper-0", "1200.50", 3, "TX")]
    cases = spark.createDataFrame([("1", "a", "2020", None), ("2", "b", "2020", "2021")], "docket string, case_name string, filed string, terminated string")
    assert [r["status"] for r in service.litigation(cases).orderBy("docket").collect()] == ["Active", "Closed"]
    parts = spark.createDataFrame([("c", "fec", 2), ("c", "osha", None)], "client string, kind string, total int")
    assert tuple(service.intelligence_summary(parts).first()) == ("c", 2, 0, 0)


def test_bucket_refresh_keeps_tags(spark, as_of):
    fresh = spark.createDataFrame([("u1", None, "t", "s1", None, None), ("u1", None, "t", "s2", 70, "wait")], "source_url string, related_ref string, title string, summary string, occu_med_score int, action_tag string")
    one = service.refresh_bucket(service.empty(spark, "federal_intel_items"), fresh.limit(1), "forecast", as_of).withColumn("action_tag", F.lit("brief"))
    two = service.refresh_bucket(one, fresh, "forecast", as_of)
    assert [(r["summary"], r["occu_med_score"], r["action_tag"]) for r in two.collect()] == [("s2", 70, "brief")]
    assert service.bucket_page(two, "forecast").first()["total"] == 1
    with pytest.raises(ValueError):
        service.bucket_page(two, "nope")


def test_state_refresh_replaces_one_partition(spark, as_of):
    items = table(spark, "state_agency_items", {"id": "1", "state_code": "TX", "bucket": "x"}, {"id": "2", "state_code": "TX", "bucket": "y"})
    profiles = table(spark, "state_profiles", {"state_code": "TX", "state_name": "Texas", "last_refreshed": '{"y":"old"}'})
    rows = results(spark, ("k", "RFP for drug testing", "bid", "https://www.tx.gov/a"), ("k", "again", "", "https://www.tx.gov/a")).drop("key")
    new, marked = service.refresh_state(items, profiles, rows, "TX", "x", as_of)
    assert sorted((r["bucket"], r["item_type"], r["relevance_score"], r["agency"]) for r in new.collect() if r["bucket"] == "x") == [("x", "rfp", 30, "tx.gov")]
    assert new.count() == 2 and '"y":"old"' in marked.first()["last_refreshed"] and '"x":"2025' in marked.first()["last_refreshed"]
    assert service.states_with_counts(profiles, new).first()["item_count"] == 2
    intel = service.refresh_intel(service.empty(spark, "state_intel_items"), rows.limit(1), registry.inline(spark, "pos int, title string, content string, url string", [(9, "Major disaster", "", "v")]), "disaster", as_of)
    assert sorted(r["severity"] for r in intel.collect()) == ["high", "low"]
    assert service.intel_counts(intel).first()["n"] == 2


def test_settings_and_providers(spark):
    settings = spark.createDataFrame([("k", "abcdefgh")], TABLES["settings"])
    change = spark.createDataFrame([("k", "one", 1), ("k", "secret12", 2), ("z", "v", 1)], "key string, value string, at int")
    new = service.put_settings(settings, change, "at")
    assert {r["key"]: r["value"] for r in service.masked_settings(new).collect()} == {"k": "****et12", "z": "v"}
    providers = spark.createDataFrame([("samGov", "k"), ("tango", "q")], "name string, key string")
    ops = table(spark, "opportunities", {"id": "a", "provider_name": "samGov"})
    env = spark.createDataFrame([("q", "")], "key string, value string")
    assert sorted(map(tuple, service.provider_status(providers, new, env, ops).collect())) == [("samGov", True, 1), ("tango", False, 0)]
