"""Campaign finance: from a search of committees to totals and the parties that money went to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.rules import PARTY, classify
from bidweave.sources.envelopes import flat, listed

COMMITTEE = "struct<committee_id:string,name:string,committee_type:string>"
CYCLE = "struct<cycle:int,receipts:double,disbursements:double,contributions:double>"
PAYMENT = "struct<recipient_name:string,disbursement_amount:double,disbursement_date:string>"
#: Cycles that are listed, and that totals are summed over; recent payments that are listed.
CYCLES, SUMMED, RECENT = 5, 4, 10
#: The type of committee that is preferred.
PREFERRED = "Q"


def primary_committee(payload: str | Column) -> Column:
    """The first committee of the preferred type, or else the first."""
    found = listed(payload, "$.results", COMMITTEE)
    best = F.try_element_at(F.filter(found, lambda c: c["committee_type"] == PREFERRED), F.lit(1))
    return F.coalesce(best, F.try_element_at(found, F.lit(1)))


def cycle_totals(payload: str | Column) -> Column:
    """The latest cycles, as the payload lists them; missing amounts are 0."""
    none = F.lit(0.0)
    amount = lambda c, name: F.coalesce(c[name], none).alias(name)
    return F.transform(F.slice(listed(payload, "$.results", CYCLE), 1, CYCLES), lambda c: F.struct(c["cycle"].alias("cycle"), amount(c, "receipts"), amount(c, "disbursements"), amount(c, "contributions")))


def _sum(cycles: Column, name: str) -> Column:
    return F.coalesce(F.aggregate(F.slice(cycles, 1, SUMMED), F.lit(0.0), lambda total, c: total + c[name]), F.lit(0.0))


def party_totals(payments: DataFrame, payload: str, key: str) -> DataFrame:
    """(key, party, amount): what the recipients of each party got."""
    rows = flat(payments, payload, "$.results", PAYMENT, [key])
    name = F.lower(F.coalesce(F.col("r")["recipient_name"], F.lit("")))
    return rows.select(key, classify(name, PARTY, "Other / Bipartisan").alias("party"), F.coalesce(F.col("r")["disbursement_amount"], F.lit(0.0)).alias("amount")).groupBy(key, "party").agg(F.sum("amount").alias("amount"))


def finance_chain(searches: DataFrame, key: str, payload: str, totals: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per search: its committee, totals over the last cycles, and the share of each party.

    ``totals`` and ``payments`` hold (committee_id, payload). Without a committee all amounts are 0 and there are no parties."""
    picked = searches.select(key, primary_committee(payload).alias("c")).select(key, F.col("c")["committee_id"].alias("committee_id"), F.col("c")["name"].alias("committee"))
    cycles = totals.select(F.col("committee_id"), cycle_totals("payload").alias("cycles"))
    with_totals = picked.join(cycles, "committee_id", "left").select("committee_id", key, "committee", "cycles", _sum(F.col("cycles"), "receipts").alias("total_receipts"), _sum(F.col("cycles"), "disbursements").alias("total_disbursements"))
    parties = party_totals(payments, "payload", "committee_id").where("amount > 0").groupBy("committee_id").agg(F.sum("amount").alias("paid"), F.map_from_entries(F.collect_list(F.struct("party", "amount"))).alias("by_party"))
    out = with_totals.join(parties, "committee_id", "left")
    got = lambda party: F.coalesce(F.try_element_at("by_party", F.lit(party)), F.lit(0.0))
    share = lambda party: F.coalesce(F.floor(got(party) / F.col("paid") * 100 + 0.5), F.lit(0)).cast("int")
    names = {"republican": "Republican", "democrat": "Democrat", "other": "Other / Bipartisan"}
    return out.select(key, "committee_id", "committee", F.coalesce(F.size("cycles"), F.lit(0)).alias("n_cycles"), "total_receipts", "total_disbursements", *[got(p).alias(n) for n, p in names.items()], *[share(p).alias(f"{n}_pct") for n, p in names.items()])
