"""Additive scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidweave.functions.dates import elapsed_days
from bidweave.functions.text import found_in, has_any

# Words and agencies that add to scores. The bases, points and limits in the functions below are fixed values too.
RELEVANCE_WORDS = [
    "occupational health", "occumed", "occu-med", "employee health", "drug testing", "pre-employment", "CDL", "DOT physical", "medical examination", "fit for duty",
    "workers comp", "workers compensation", "clinic", "mobile medical", "FMCSA", "POST physical", "nurse", "physician", "industrial hygiene", "EHS",
    "contract", "RFP", "RFI", "bid", "award", "procurement", "solicitation",
]
SET_ASIDES = ["small business", "8(a)", "sdvosb", "wosb"]
FORECAST_AGENCIES = ["department of defense", "department of homeland security", "department of state", "department of justice", "department of health"]
FORECAST_TERMS = [
    "occupational health", "occupational medicine", "medical surveillance", "drug testing", "fit for duty", "workers comp", "physical exam", "dot physical", "osha",
    "industrial hygiene", "employee health", "health services", "medical services",
]
FORECAST_CODES = ["621111", "621999", "621610"]
RECOMPETE_AGENCIES = ["defense", "homeland security", "state", "justice", "health", "cbp", "ice", "uscis", "bop", "opm", "osha", "fmcsa", "faa"]
OVERSIGHT_TERMS = ["health", "medical", "workforce", "safety", "occupational", "osha", "worker"]
OVERSIGHT_AGENCIES = ["defense", "homeland", "dod", "dhs", "state", "justice", "hhs", "opm", "bop"]
POLICY_TERMS = ["occupational health", "medical", "worker health", "osha", "workforce health", "federal employee health"]
INCUMBENT_AGENCIES = ["defense", "homeland", "state", "justice", "health", "cbp", "ice", "uscis", "bop", "opm"]
LEADERSHIP_AGENCIES = ["defense", "homeland", "state", "justice", "health", "transportation", "opm", "labor"]
LEADERSHIP_TERMS = ["medical", "health", "occupational"]
BUDGET_TERMS = ["health", "medical", "workforce", "safety", "occupational"]
BUDGET_AGENCIES = ["defense", "homeland", "state", "justice", "hhs", "opm"]


def total(base: int, *parts: tuple[Column, int], cap: int | None = 100) -> Column:
    """Base and the points of the parts that hold, capped. A null condition adds nothing."""
    out = F.lit(base)
    for condition, points in parts:
        out = out + F.when(condition, points).otherwise(0)
    return F.least(out, F.lit(cap)) if cap else out


def keyword_relevance(text: Column) -> Column:
    """Ten points for each word that the lower-case text holds, a hundred at most."""
    return F.least(F.lit(100), F.size(found_in(text, [w.lower() for w in RELEVANCE_WORDS])) * 10)


def forecast(text: Column) -> Column:
    return total(20, (has_any(text, FORECAST_AGENCIES), 25), (has_any(text, FORECAST_TERMS), 35), (has_any(text, FORECAST_CODES), 20))


def recompete(agency: Column, days: Column, amount: Column) -> Column:
    """An award that has already ended counts as one that ends within a year."""
    return total(20, (has_any(agency, RECOMPETE_AGENCIES), 25), (days < 365, 30), ((days >= 365) & (days < 548), 15), (amount > 1_000_000, 15))


def oversight(text: Column, agency: Column) -> Column:
    return total(25, (has_any(text, OVERSIGHT_TERMS), 30), (has_any(agency, OVERSIGHT_AGENCIES), 25))


def policy(text: Column, kind: Column) -> Column:
    return total(20, (has_any(text, POLICY_TERMS), 40), (kind.isin("RULE", "PRORULE"), 20))


def incumbent(agency: Column, amount: Column) -> Column:
    return total(30, (has_any(agency, INCUMBENT_AGENCIES), 30), (amount > 5_000_000, 25), ((amount > 1_000_000) & (amount <= 5_000_000), 15))


def leadership(department: Column, title: Column) -> Column:
    return total(30, (has_any(department, LEADERSHIP_AGENCIES), 30), (has_any(title, LEADERSHIP_TERMS), 25))


def budget(text: Column) -> Column:
    return total(20, (has_any(text, BUDGET_TERMS), 35), (has_any(text, BUDGET_AGENCIES), 25))


def opportunity(status: Column, deadline: Column, naics: Column, description: Column, url: Column, set_aside: Column, text: Column, as_of: Column, codes: list[str], keywords: list[str], preferred: list[str]) -> tuple[Column, Column]:
    """Rank score (no cap) and the list of signals, in the order in which they are tested."""
    days = elapsed_days(deadline, as_of)
    filled = lambda c: c.isNotNull() & (c != "")
    aside = F.lower(set_aside)
    score = total(
        0,
        (status == "active", 20),
        (deadline.isNotNull(), 10),
        (days.between(1, 14), 15),
        (filled(naics), 5),
        (naics.isin(codes), 20),
        (filled(description), 5),
        (filled(url), 5),
        (has_any(aside, SET_ASIDES), 15),
        (has_any(aside, [p.lower() for p in preferred]), 10),
        *[(F.contains(text, F.lit(k.lower())), 10) for k in keywords],
        cap=None,
    )
    signals = F.array_compact(
        F.array(
            F.when(status == "active", "Active opportunity"),
            F.when(days > 0, F.concat(F.lit("Response due in "), days.cast("string"), F.lit(" days"))),
            F.when(naics.isin(codes), F.concat(F.lit("Matching NAICS: "), naics)),
            F.when(has_any(aside, SET_ASIDES), F.concat(F.lit("Set-aside: "), set_aside)),
            *[F.when(F.contains(text, F.lit(k.lower())), f"Keyword match: {k}") for k in keywords],
        )
    )
    return score, signals
