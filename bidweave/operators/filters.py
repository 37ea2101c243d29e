"""Filters, gates, fall-backs and pages."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidweave.functions.text import as_col, has_any, url_host

# Hosts that are no procurement sources, words that a candidate must have, words that reject it.
BLOCKED_DOMAINS = [
    "linkedin.com", "facebook.com", "twitter.com", "instagram.com", "x.com", "reddit.com", "youtube.com", "tiktok.com",
    "wikipedia.org", "britannica.com", "govinfo.gov", "federalregister.gov", "usaspending.gov", "fpds.gov", "regulations.gov", "gao.gov", "opm.gov",
    "bloomberg.com", "reuters.com", "wsj.com", "nytimes.com", "washingtonpost.com", "forbes.com", "inc.com", "businesswire.com", "prnewswire.com", "businessinsider.com",
    "apnews.com", "cnbc.com", "cnn.com", "foxbusiness.com", "politico.com", "govexec.com", "nextgov.com", "federalnewsnetwork.com",
    "indeed.com", "glassdoor.com", "ziprecruiter.com", "monster.com", "careerbuilder.com", "simplyhired.com", "usajobs.gov", "jobs.mil",
    "yelp.com", "healthgrades.com", "webmd.com", "healthline.com", "scribd.com", "slideshare.net", "issuu.com", "gartner.com", "capterra.com", "g2.com",
]
PROCUREMENT_WORDS = [
    "rfp", "request for proposal", "request for proposals", "solicitation", "invitation to bid", "invitation for bid", "itb", "rfq", "request for quotation", "bid opportunity",
    "bid notice", "sources sought", "pre-solicitation", "response due", "proposals due", "submission deadline", "bids due", "seeking proposals", "contract opportunity", "procurement notice",
]
REJECT_WORDS = [
    "contract awarded", "contract award", "award notice", "award announcement", "awarded to", "selected vendor", "task order award", "mod to contract",
    "contract modification", "job description", "job posting", "we are hiring", "career opportunity",
]


def any_ilike(term: str | None, *columns: str) -> Column | None:
    """Case-insensitive pattern over several columns. Wildcards in the term stay wildcards; no term, no predicate."""
    return reduce(or_, [F.ilike(F.col(c), F.lit(f"%{term}%")) for c in columns]) if term else None


def holds(term: str, *columns: str) -> Column:
    """Literal, case-insensitive substring in any of the columns; null holds nothing."""
    return reduce(or_, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(term.lower())) for c in columns])


def equals(column: str, value: str | None) -> Column | None:
    """Equality; null and ``all`` mean no predicate."""
    return None if value in (None, "", "all") else F.col(column) == value


def matching(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """The conjunction of the predicates that are given."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(and_, given)) if given else df


def page(df: DataFrame, order: list[Column], number: int = 1, size: int = 50, largest: int = 200) -> DataFrame:
    """One page in order, with ``pos`` from 1 and ``total``, the rows of all pages.

    Only the rows up to the page's end are ordered (a top-k), and the total is one scalar beside them."""
    size = min(largest, size if size > 0 else 50)
    number = max(1, number)
    total = df.agg(F.count("*").alias("total")).scalar()
    top = df.orderBy(*order).offset((number - 1) * size).limit(size)
    placed = top.withColumn("pos", F.row_number().over(Window.orderBy(*order)) + F.lit((number - 1) * size))
    return placed.withColumn("total", total)


def soft_filter(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that satisfy the predicate, or all rows where none does. The answer is one scalar, found in parallel."""
    hits = df.agg(F.count_if(predicate).alias("hits")).scalar()
    return df.where(predicate | (hits == 0))


def with_fallback(first: DataFrame, second: DataFrame, least: int = 1) -> DataFrame:
    """The first source, with the second added where the first has fewer than ``least`` rows."""
    found = first.limit(least).agg(F.count("*").alias("n")).scalar()
    return first.unionByName(second.where(found < least))


def blocked(url: str | Column, domains: Iterable[str] = BLOCKED_DOMAINS) -> Column:
    """Whether the URL's host is one of the domains or below one; what is no URL isn't blocked."""
    host = url_host(as_col(url))
    listed = F.array(*[F.lit(d) for d in domains])
    return F.coalesce(F.exists(listed, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d))), F.lit(False))


def gate(text: Column, keep: Iterable[str] = PROCUREMENT_WORDS, reject: Iterable[str] = REJECT_WORDS) -> Column:
    """Rejects first, then asks for one of the words to keep."""
    return ~has_any(text, reject) & has_any(text, keep)


def in_domain(column: str | Column, allowed: Iterable[str], default: str) -> Column:
    """The value if the domain has it, else the default."""
    c = as_col(column)
    return F.when(c.isin(list(allowed)), c).otherwise(default)


def first_rows(df: DataFrame, predicate: Column, order: list[Column], n: int) -> DataFrame:
    """The first n rows that satisfy the predicate, with their position."""
    return df.where(predicate).orderBy(*order).limit(n).withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def placed(df: DataFrame, parents: list[str], order: list[Column]) -> DataFrame:
    """All rows with their position among those of the same parent."""
    return df.withColumn("pos", F.row_number().over(Window.partitionBy(*parents).orderBy(*order)))
