"""Schemas: storage tables, canonical records, candidates, votes; enum domains in declaration order."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """``name type[!]`` pairs; ! means not null. Types: s string, i int, t timestamp without zone, b boolean, d decimal."""
    kinds = {"s": T.StringType(), "i": T.IntegerType(), "t": T.TimestampNTZType(), "b": T.BooleanType(), "d": T.DecimalType(38, 6)}
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        fields.append(T.StructField(name, kinds[kind.rstrip("!")], not kind.endswith("!")))
    return T.StructType(fields)


STRINGS = T.ArrayType(T.StringType())

TABLES = {
    "opportunities": _struct("id s!,notice_id s,title s!,agency s!,sub_agency s,office s,type s!,status s!,naics_code s,naics_description s,psc_code s,contract_type s,posted_date t!,response_deadline t,period_of_performance s,set_aside s,place_of_performance s,description s,solicitation_number s,sam_url s,estimated_value d,ceiling_value d,floor_value d,award_amount d,awardee s,source s!,provider_name s,relevance_score d,source_confidence s,tags s,notes s,created_at t!,updated_at t!"),
    "settings": _struct("key s!,value s!"),
    "competitors": _struct("id s!,name s!,website s,description s,services s,coverage_states s,tier s!,headquarters s,employee_count s,founded s,notes s,recent_activity s,contract_wins s,intelligence_sources s,news_articles s,fec_filings s,last_researched t,created_at t!,updated_at t!"),
    "prospects": _struct("id s!,name s!,website s,description s,industry s,headquarters s,employee_count s,founded s,naics_codes s,status s!,tier s!,notes s,research_summary s,opportunity_signals s,intelligence_sources s,last_researched t,created_at t!,updated_at t!"),
    "prospect_locations": _struct("id s!,prospect_id s!,name s,type s!,city s,state s,country s!,address s,employee_estimate s,description s,open_positions i,health_positions i,hiring_trend s,hiring_categories s,jobs_last_updated t,source_url s,created_at t!,updated_at t!"),
    "prospect_jobs": _struct("id s!,prospect_id s!,location_id s,title s!,department s,raw_location s,job_type s,posted_date s,url s,snippet s,is_health_related b,health_relevance_reason s,created_at t!"),
    "prospect_contacts": _struct("id s!,prospect_id s!,name s!,category s!,title s,department s,is_ehs_contact b,is_key_contact b,linkedin_url s,email s,notes s,created_at t!,updated_at t!"),
    "client_contacts": _struct("id s!,client_id s!,name s!,category s!,title s,department s,is_ehs_contact b,is_key_contact b,linkedin_url s,email s,notes s,created_at t!,updated_at t!"),
    "clients": _struct("id s!,name s!,website s,industry s,headquarters s,logo_url s,overall_hiring_trend s,created_at t!,updated_at t!"),
    "client_branches": _struct("id s!,client_id s!,name s,city s,country s!,state s,address s,branch_type s!,last_researched t,hiring_trend_summary s,hiring_trend_direction s,posting_count s,source_url s,created_at t!,updated_at t!"),
    "branch_hiring_posts": _struct("id s!,branch_id s!,client_id s!,title s!,department s,url s,posted_date s,source s,raw_json s,created_at t!"),
    "federal_intel_items": _struct("id s!,bucket s!,source_type s!,agency s,component s,office s,region_country s,title s!,summary s,date_posted t,status s,contractor_incumbent s,related_ref s,budget_signal s,oversight_signal s,medical_travel_relevance s,occu_med_score i,action_tag s,source_url s,raw_json s,fetched_at t,created_at t!,updated_at t!"),
    "state_profiles": _struct("state_code s!,state_name s!,region s!,osha_state_plan s!,last_refreshed s,created_at t!"),
    "state_agency_items": _struct("id s!,state_code s!,bucket s!,title s!,summary s,url s,published_date s,agency s,item_type s,relevance_score i,raw_json s,fetched_at t,created_at t!"),
    "state_intel_items": _struct("id s!,channel s!,title s!,summary s,url s,published_date s,source s,severity s,affected_states s,raw_json s,fetched_at t,created_at t!"),
}

CANONICAL = _struct("external_id s,title s,agency s,sub_agency s,type s,status s,naics_code s,naics_description s,posted_date t,response_deadline t,set_aside s,place_of_performance s,description s,solicitation_number s,source_url s,estimated_value d,award_amount d,awardee s,source s,raw_data s")
CANDIDATE = _struct("title s,url s,content s,source_provider s,enriched b")
VOTE = _struct("scorer s,score i,explanation s,passed b")

#: Enum domains; they sort in this order.
DOMAINS = {
    "opportunity_status": "active archived".split(),
    "opportunity_source": "sam_gov csv_import manual".split(),
    "competitor_tier": "local regional national".split(),
    "prospect_status": "prospect lead qualified active".split(),
    "prospect_tier": "strategic enterprise mid-market".split(),
    "contact_category": "ceo_leadership finance human_resources legal_compliance ehs_safety quality operations technology procurement_supply_chain board_governance communications strategy business_unit other".split(),
    "federal_bucket": "forecast recompete-watch agency-pain policy-radar incumbent-tracker leadership-org deployment-medical budget-funding protest-litigation".split(),
    "action_tag": "monitor pursue brief contact wait".split(),
    "intel_channel": "public_health travel_advisory fda_recalls disaster".split(),
}


def ordinal(column, domain: list[str]):
    """Place of a value in its domain, from 1; 0 for a value outside, null for null."""
    from pyspark.sql import functions as F

    return F.array_position(F.array(*[F.lit(d) for d in domain]), column)
