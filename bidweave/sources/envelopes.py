"""JSON payloads of notices, awards, hits, articles, postings, cases and filings to flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.dates import elapsed_days, permissive
from bidweave.functions.rules import action_tag
from bidweave.operators import scoring

PLACE = "struct<city:struct<name:string>,state:struct<code:string>>"
NOTICE = f"struct<noticeId:string,title:string,solicitationNumber:string,fullParentPathName:string,type:string,baseType:string,active:string,naicsCode:string,postedDate:string,responseDeadLine:string,typeOfSetAside:string,typeOfSetAsideDescription:string,placeOfPerformance:{PLACE},description:string,uiLink:string,award:struct<amount:string,awardee:struct<name:string>>>"
AWARD = "struct<`Award ID`:string,`Recipient Name`:string,`Award Amount`:double,`Awarding Agency`:string,`Awarding Sub Agency`:string,`Start Date`:string,`End Date`:string,`Description`:string,`NAICS Code`:string,`NAICS Description`:string>"


def path_part(path: Column, number: int) -> Column:
    """A part of a dotted path, trimmed; null beyond its end."""
    return F.trim(F.try_element_at(F.split(path, r"\."), F.lit(number)))


def listed(payload: str | Column, list_path: str, schema: str) -> Column:
    """The list at a path of a JSON payload, read in one pass with the fields that are asked for; null for bad JSON."""
    parts = list_path.removeprefix("$.").split(".")
    kind = f"array<{schema}>"
    for part in reversed(parts):
        kind = f"struct<`{part}`:{kind}>"
    found = F.from_json(F.col(payload) if isinstance(payload, str) else payload, kind)
    for part in parts:
        found = found[part]
    return found


def flat(df: DataFrame, payload: str, list_path: str, schema: str, keep: list[str], first: int | None = None) -> DataFrame:
    """The elements of a list inside a JSON payload, with their position; bad JSON gives none."""
    array = listed(payload, list_path, schema)
    if first:
        array = F.slice(array, 1, first)
    return df.select(*keep, F.posexplode(array).alias("pos", "r"))


def notices(df: DataFrame, payload: str, keep: list[str], as_of: Column) -> DataFrame:
    """Notices as canonical records; those without a date were posted at ``as_of``."""
    rows = flat(df, payload, "$.opportunitiesData", NOTICE, keep)
    r = F.col("r")
    return rows.select(
        *keep,
        r["noticeId"].alias("external_id"),
        F.coalesce(r["title"], F.lit("Untitled")).alias("title"),
        path_part(F.coalesce(r["fullParentPathName"], F.lit("")), 1).alias("agency"),
        path_part(F.coalesce(r["fullParentPathName"], F.lit("")), 2).alias("sub_agency"),
        F.coalesce(r["type"], r["baseType"], F.lit("Solicitation")).alias("type"),
        F.when(r["active"] == "Yes", "active").otherwise("archived").alias("status"),
        r["naicsCode"].alias("naics_code"),
        F.coalesce(permissive(r["postedDate"]), as_of).alias("posted_date"),
        permissive(r["responseDeadLine"]).alias("response_deadline"),
        F.coalesce(r["typeOfSetAsideDescription"], r["typeOfSetAside"]).alias("set_aside"),
        F.nullif(F.concat_ws(", ", F.nullif(r["placeOfPerformance"]["city"]["name"], F.lit("")), F.nullif(r["placeOfPerformance"]["state"]["code"], F.lit(""))), F.lit("")).alias("place_of_performance"),
        r["award"]["amount"].try_cast("double").alias("award_amount"),
        r["award"]["awardee"]["name"].alias("awardee"),
    )


def forecast_items(df: DataFrame, payload: str, keep: list[str], first: int = 40) -> DataFrame:
    """Pre-solicitation notices with score and tag."""
    r = F.col("r")
    rows = flat(df, payload, "$.opportunitiesData", NOTICE, keep, first)
    text = F.lower(F.concat_ws(" ", *[F.coalesce(r[c], F.lit("")) for c in ("title", "description", "fullParentPathName")]))
    return rows.select(*keep, "pos", r["title"].alias("title"), path_part(r["fullParentPathName"], 1).alias("agency"), scoring.forecast(text).alias("score")).withColumn("tag", action_tag(F.col("score")))


def closing_items(df: DataFrame, payload: str, keep: list[str], as_of: Column, first: int = 30) -> DataFrame:
    """Active notices by the distance of their deadline."""
    r = F.col("r")
    rows = flat(df, payload, "$.opportunitiesData", NOTICE, keep, first)
    days = elapsed_days(permissive(r["responseDeadLine"]), as_of)
    urgent = F.coalesce(days.between(0, 89), F.lit(False))
    return rows.select(*keep, "pos", F.coalesce(r["title"], F.lit("Active Notice")).alias("title"), days.alias("days"), F.when(urgent, "closing-soon").otherwise("active").alias("status"), F.when(urgent, 75).otherwise(45).alias("score"), F.when(urgent, "pursue").otherwise("monitor").alias("tag"))


def _awards(df: DataFrame, payload: str, keep: list[str], first: int) -> DataFrame:
    """The listed awards (keep, pos, r) with the text of their agencies and the moment of their end, each read once."""
    r = F.col("r")
    agency = F.lower(F.concat_ws(" ", F.coalesce(r["Awarding Agency"], F.lit("")), F.coalesce(r["Awarding Sub Agency"], F.lit(""))))
    return flat(df, payload, "$.results", AWARD, keep, first).select("*", agency.alias("_agency"), permissive(r["End Date"]).alias("_end"))


def _award_fields(as_of: Column) -> list[Column]:
    r, days = F.col("r"), elapsed_days(F.col("_end"), as_of)
    return [
        F.concat(F.lit("Award: "), F.coalesce(r["Award ID"], F.lit("Unknown")), F.lit(" — "), F.coalesce(r["Recipient Name"], F.lit("Unknown"))).alias("title"),
        days.alias("days"),
        F.when(days < 548, "recompete-window").otherwise("active").alias("status"),
        scoring.recompete(F.col("_agency"), days, r["Award Amount"]).alias("score"),
        F.when(days < 548, "pursue").otherwise("monitor").alias("tag"),
    ]


def _incumbent_fields(as_of: Column) -> list[Column]:
    r = F.col("r")
    return [
        F.concat(F.coalesce(r["Recipient Name"], F.lit("Unknown Recipient")), F.lit(" — "), F.coalesce(r["NAICS Description"], r["NAICS Code"], F.lit("Healthcare"))).alias("title"),
        F.when(F.col("_end") < as_of, "expired").otherwise("active").alias("status"),
        scoring.incumbent(F.col("_agency"), r["Award Amount"]).alias("score"),
    ]


def award_items(df: DataFrame, payload: str, keep: list[str], as_of: Column, first: int = 40) -> DataFrame:
    """Awards by the distance of their end: recompete items."""
    return _awards(df, payload, keep, first).select(*keep, "pos", *_award_fields(as_of))


def incumbent_items(df: DataFrame, payload: str, keep: list[str], as_of: Column, first: int = 40) -> DataFrame:
    """Awards as incumbents: active until their end."""
    return _awards(df, payload, keep, first).select(*keep, "pos", *_incumbent_fields(as_of))


def award_pairs(df: DataFrame, payload: str, keep: list[str], as_of: Column, first: int = 40) -> DataFrame:
    """Each award as a recompete item and as an incumbent, two structs beside each other, from one reading of the payload."""
    return _awards(df, payload, keep, first).select(*keep, "pos", F.struct(*_award_fields(as_of)).alias("award"), F.struct(*_incumbent_fields(as_of)).alias("incumbent"))


def search_hits(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Hits under ``hits.hits`` or ``results``, each in ``_source`` or in the hit itself."""
    hit = "struct<_source:struct<title:string,summary:string,agency_name:string>,title:string,summary:string,agency_name:string>"
    rows = df.select(*keep, F.posexplode(F.coalesce(listed(payload, "$.hits.hits", hit), listed(payload, "$.results", hit))).alias("pos", "r"))
    pick = lambda c: F.when(F.col("r")["_source"].isNotNull(), F.col("r")["_source"][c]).otherwise(F.col("r")[c]).alias(c)
    return rows.select(*keep, "pos", pick("title"), pick("summary"), pick("agency_name"))


def articles(df: DataFrame, payload: str, keep: list[str], first: int = 25) -> DataFrame:
    """Register articles with their policy score."""
    rows = flat(df, payload, "$.results", "struct<title:string,abstract:string,type:string,document_number:string>", keep, first)
    r = F.col("r")
    text = F.lower(F.concat_ws(" ", F.coalesce(r["title"], F.lit("")), F.coalesce(r["abstract"], F.lit(""))))
    return rows.select(*keep, "pos", r["title"].alias("title"), r["document_number"].alias("ref"), scoring.policy(text, r["type"]).alias("score"))


def postings(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Job postings with nested arrays: the first duty and the first address."""
    item = "struct<MatchedObjectDescriptor:struct<PositionTitle:string,DepartmentName:string,OrganizationName:string,ApplyURI:array<string>,UserArea:struct<Details:struct<MajorDuties:array<string>>>>>"
    rows = flat(df, payload, "$.SearchResult.SearchResultItems", item, keep)
    d = F.col("r")["MatchedObjectDescriptor"]
    department = F.lower(F.concat_ws(" ", F.coalesce(d["DepartmentName"], F.lit("")), F.coalesce(d["OrganizationName"], F.lit(""))))
    return rows.select(*keep, "pos", d["PositionTitle"].alias("title"), F.try_element_at(d["UserArea"]["Details"]["MajorDuties"], F.lit(1)).alias("duty"), F.try_element_at(d["ApplyURI"], F.lit(1)).alias("url"), scoring.leadership(department, F.lower(F.coalesce(d["PositionTitle"], F.lit("")))).alias("score"))


def budget_documents(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    rows = flat(df, payload, "$.results", "struct<title:string,abstractText:string>", keep)
    r = F.col("r")
    return rows.select(*keep, "pos", r["title"].alias("title"), scoring.budget(F.lower(F.concat_ws(" ", F.coalesce(r["title"], F.lit("")), F.coalesce(r["abstractText"], F.lit(""))))).alias("score"))


def court_cases(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Cases: active until they are terminated."""
    rows = flat(df, payload, "$.results", "struct<docket_id:string,caseName:string,dateFiled:string,dateTerminated:string>", keep)
    r = F.col("r")
    return rows.select(*keep, "pos", r["docket_id"].alias("docket"), r["caseName"].alias("case_name"), F.when(r["dateTerminated"].isNull(), "Active").otherwise("Closed").alias("status"), r["dateFiled"].alias("filed"))


def disbursements(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    rows = flat(df, payload, "$.results", "struct<recipient_name:string,disbursement_amount:double,disbursement_date:string>", keep)
    r = F.col("r")
    return rows.select(*keep, "pos", F.coalesce(r["recipient_name"], F.lit("")).alias("recipient"), F.coalesce(r["disbursement_amount"], F.lit(0.0)).alias("amount"), r["disbursement_date"].alias("date"))
