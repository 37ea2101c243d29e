"""Ordered rule classifiers: tables of (label, needles), compiled to one CASE.

The needles are substrings of lower-case text, not words.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave.functions.text import bound, has_any

Rules = list[tuple[str, list[str]]]

# Classes and needles, in the order in which they are tried.
BRANCH_TYPE: Rules = [
    ("headquarters", ["headquarter", "hq", "corporate office"]),
    ("manufacturing", ["manufactur", "plant", "factory", "assembly"]),
    ("research", ["research", "r&d", "lab"]),
    ("depot", ["depot", "maintenance"]),
    ("field_operations", ["field", "operations"]),
    ("data_center", ["data center", "datacenter"]),
    ("training", ["training"]),
    ("distribution", ["distribution", "warehouse"]),
]
LOCATION_TYPE: Rules = [
    ("headquarters", ["headquarter", "hq", "corporate office"]),
    ("manufacturing", ["manufactur", "plant", "factory", "assembly"]),
    ("research", ["research", "r&d", "lab"]),
    ("testing", ["test", "range"]),
    ("warehouse", ["warehouse", "distribution"]),
    ("training", ["training"]),
    ("service_center", ["service center", "depot"]),
]
BRANCH_DEPARTMENT: Rules = [
    ("Engineering", ["engineer", "engineering"]),
    ("Manufacturing", ["manufactur", "production"]),
    ("Software & IT", ["software", "developer"]),
    ("Health & Safety", ["safety", "health", "medical"]),
    ("Logistics", ["logistics", "supply chain"]),
    ("Finance", ["finance", "accounting"]),
    ("HR", ["hr", "human resources"]),
]
JOB_DEPARTMENT: Rules = [
    ("Engineering", ["engineer", "engineering"]),
    ("Manufacturing", ["manufactur", "production", "machinist"]),
    ("Software & IT", ["software", "developer", "data "]),
    ("Finance", ["finance", "accounting"]),
    ("Supply Chain", ["supply chain", "logistics", "procurement"]),
    ("HR", ["hr", "human resources", "talent"]),
    ("Security", ["security", "cyber"]),
    ("Program Management", ["program manager", "project manager"]),
]
JOB_TYPE: Rules = [("part-time", ["part-time", "part time"]), ("contract", ["contract", "contractor"]), ("intern", ["intern"])]
POSTING_SITE: Rules = [("LinkedIn", ["linkedin"]), ("Indeed", ["indeed"])]
ITEM_TYPE: Rules = [
    ("rfp", ["rfp", "request for proposal", "solicitation"]),
    ("rfi", ["rfi", "request for information"]),
    ("award", ["award", "contract award"]),
    ("legislation", ["bill", "legislation", "act", "statute"]),
    ("notice", ["alert", "notice", "bulletin", "advisory"]),
    ("warn", ["warn", "layoff", "closure"]),
    ("safety", ["recall", "safety"]),
    ("emergency", ["declaration", "emergency", "disaster"]),
]
SEVERITY: Rules = [
    ("high", ["level 4", "do not travel", "major disaster", "urgent", "emergency"]),
    ("medium", ["level 3", "reconsider travel", "alert", "significant"]),
]
SIGNAL_TYPE: Rules = [
    ("RFP", ["rfp", "solicitation", "bid"]),
    ("Contract Award", ["award", "contract win", "selected"]),
    ("Expansion", ["expansion", "new facility", "opening"]),
    ("Health Program", ["health", "medical", "safety", "wellness"]),
]
PARTY: Rules = [("Republican", ["republican", "rnc", "nrcc", "nrsc", "gop"]), ("Democrat", ["democrat", "dnc", "dccc", "dscc"])]
CLIENT_CONTACT: Rules = [
    ("ceo_leadership", ["ceo", "chair", "president", "vice chair", "coo", "general manager"]),
    ("finance", ["cfo", "finance", "accounting", "controller", "treasurer"]),
    ("human_resources", ["human resource", "people", "chro", "talent", "belonging", "dei", "workforce", "hr ", " hr"]),
    ("legal_compliance", ["legal", "compliance", "counsel", "governance", "regulatory", "parole"]),
    ("ehs_safety", ["ehs", "safety", "environment", "hseq", "hse", "health care", "psychologist", "clinical", "medical"]),
    ("quality", ["quality"]),
    ("technology", ["technology", "digital", "cyber", "cio", "cto", "information officer", "it "]),
    ("procurement_supply_chain", ["procurement", "supply chain", "purchasing", "contract", "logistics", "subcontract"]),
    ("board_governance", ["board", "director", "advisory", "supervisory", "ward", "trustee"]),
    ("communications", ["communicat", "media", "public affairs", "press", "external affairs", "customer experience"]),
    ("strategy", ["strategy", "development", "growth", "business dev", "legislative", "planning"]),
    ("operations", ["operations", "division", "sector", "warden", "facility", "regional", "field operations"]),
]
PROSPECT_CONTACT: Rules = [
    ("ceo_leadership", ["ceo", "chair", "president", "vice chair", "coo"]),
    ("finance", ["cfo", "finance", "accounting", "controller"]),
    ("human_resources", ["human resource", "people", "chro", "talent", "belonging", "dei", "workforce"]),
    ("legal_compliance", ["legal", "compliance", "counsel", "governance", "regulatory"]),
    ("ehs_safety", ["ehs", "safety", "environment", "hseq", "hse"]),
    ("quality", ["quality"]),
    ("technology", ["technology", "digital", "cyber", "it ", " it", "cio", "cto", "information"]),
    ("procurement_supply_chain", ["procurement", "supply chain", "purchasing", "contract", "logistics", "subcontract", "materials"]),
    ("board_governance", ["board", "director", "advisory", "supervisory", "governance"]),
    ("communications", ["communicat", "sustainability", "brand", "media", "public affairs"]),
    ("strategy", ["strategy", "development", "growth", "business dev"]),
    ("operations", ["business unit", "business group", "division", "sector", "operations"]),
]
EHS_WORDS = ["ehs", "hse", "hseq", "safety", "environment, health", "occupational health", "industrial hygiene"]
CLIENT_EHS_WORDS = [*EHS_WORDS, "health care services", "medical facility"]
KEY_CATEGORIES = ["ceo_leadership", "human_resources", "ehs_safety", "quality"]
HEALTH_KEYWORDS = [
    "occupational health", "industrial hygiene", "ehs", "environmental health",
    "safety", "health nurse", "physician", "medical", "wellness", "ergonomist",
    "industrial medicine", "occupational medicine", "first responder", "emt",
    "paramedic", "health technician", "safety officer", "safety manager",
    "injury prevention", "workers comp", "clinical", "health program",
    "toxicologist", "industrial nurse", "site medic", "medical director",
]
WIN_WORDS = ["award", "contract", "win", "selected", "signed", "procurement"]
SERVICE_CATEGORIES = ["Drug Testing", "DOT Physicals", "Workers Comp", "Onsite Clinics", "Telehealth", "Wellness", "Mental Health", "Absence Management"]


def classify(text: Column, rules: Rules, default: str | None = None) -> Column:
    """The label of the first rule of which the (lower-case) text holds a needle."""

    def case(t: Column) -> Column:
        out = None
        for label, needles in rules:
            out = F.when(has_any(t, needles), label) if out is None else out.when(has_any(t, needles), label)
        return out.otherwise(F.lit(default))

    return bound(text, case)


def client_contact(raw: Column, rules: Rules = CLIENT_CONTACT, default: str = "other") -> Column:
    """Contact category of a client; ``secretary`` of an ``agency`` also leads."""
    text = F.lower(raw)
    return F.when(F.contains(text, F.lit("secretary")) & F.contains(text, F.lit("agency")), "ceo_leadership").otherwise(classify(text, rules, default))


def hiring_level(count: Column) -> Column:
    return F.when(count >= 15, "high").when(count >= 5, "medium").when(count >= 1, "low").otherwise("none")


def hiring_trend(count: Column) -> Column:
    return F.when(count > 10, "growing").when(count > 0, "stable").otherwise("contracting")


def hiring_sentence(count: Column) -> Column:
    n = count.cast("string")
    return (
        F.when(count > 10, F.concat(n, F.lit(" open positions found. Active hiring activity.")))
        .when(count > 3, F.concat(n, F.lit(" open positions found. Moderate hiring activity.")))
        .when(count > 0, F.concat(n, F.lit(" open position(s) found. Limited hiring activity.")))
        .otherwise("No open positions found in recent search.")
    )


def confidence(score: Column, fallback: Column | None = None) -> Column:
    out = F.when(fallback, "low") if fallback is not None else F.when(F.lit(False), "low")
    return out.when(score >= 75, "high").when(score >= 50, "medium").when(score.isNotNull(), "low")


def action_tag(score: Column) -> Column:
    return F.when(score >= 70, "pursue").when(score >= 45, "monitor").otherwise("wait")


def score_band(score: Column) -> Column:
    return F.when(score >= 70, "high").when(score >= 45, "medium").otherwise("low")
