"""Payloads of web searches to rows: one shape for all, ids and scores as the sources give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidweave.functions.text import first_filled, short_base64
from bidweave.operators.dedupe import first_seen
from bidweave.sources.envelopes import flat, listed

#: Queries that a source is asked at most, and the score of its hits.
QUERIES, HIT_SCORE = 4, 50

WEB = "struct<title:string,link:string,snippet:string,date:string,source:string>"
DEEP = "struct<title:string,url:string,content:string,score:double,published_date:string>"
NEURAL = "struct<title:string,url:string,publishedDate:string,highlights:array<string>,text:string>"
PAGE = "struct<title:string,name:string,url:string,description:string,snippet:string,snippets:array<string>>"


def web_results(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Results under ``organic``, or else ``news``; missing title, link and snippet are empty."""
    found = F.coalesce(listed(payload, "$.organic", WEB), listed(payload, "$.news", WEB))
    r = F.col("r")
    text = lambda c: F.coalesce(r[c], F.lit("")).alias(c)
    return df.select(*keep, F.posexplode(found).alias("pos", "r")).select(*keep, "pos", text("title"), text("link"), text("snippet"), r["date"].alias("date"), r["source"].alias("source"))


def unique_links(results: DataFrame, order: list[str]) -> DataFrame:
    """The first result of each link over all queries; results without a link are left out."""
    return first_seen(results.where("link <> ''"), "link", order)


def neural_results(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Results with their highlights, or else their text, as content."""
    r = F.col("r")
    content = first_filled(F.concat_ws(" ", r["highlights"]), r["text"])
    return flat(df, payload, "$.results", NEURAL, keep).select(*keep, "pos", r["title"].alias("title"), r["url"].alias("url"), content.alias("content"), r["publishedDate"].alias("published"))


def research_results(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Results with whole content and the source's own score, 0 where it gives none."""
    r = F.col("r")
    text = lambda c: F.coalesce(r[c], F.lit("")).alias(c)
    return flat(df, payload, "$.results", DEEP, keep).select(*keep, "pos", text("title"), text("url"), text("content"), F.coalesce(r["score"], F.lit(0.0)).alias("score"), r["published_date"].alias("published"))


def extracted_pages(df: DataFrame, payload: str) -> DataFrame:
    """(url, raw_content) of the pages that were fetched; those without url or content are left out."""
    r = F.col("r")
    rows = flat(df, payload, "$.results", "struct<url:string,raw_content:string>", []).select(r["url"].alias("url"), r["raw_content"].alias("raw_content"))
    return rows.where("url <> '' AND raw_content <> ''")


def with_pages(results: DataFrame, pages: DataFrame) -> DataFrame:
    """The results with the content of their page where it was fetched."""
    whole = pages.groupBy("url").agg(F.max("raw_content").alias("_raw"))
    return results.join(whole, "url", "left").withColumn("content", F.coalesce("_raw", "content")).drop("_raw")


#: Where each source lists its hits, and what their title and description are.
SHAPES: dict[str, tuple[list[str], str, list[str]]] = {
    "you": (["$.hits"], "title", ["snippets", "description"]),
    "langsearch": (["$.webPages.value"], "name", ["snippet"]),
    "websearch": (["$.results", "$.organic"], "title", ["snippet", "description"]),
}


def provider_hits(df: DataFrame, payload: str, provider: str, query_idx: str, keep: list[str]) -> DataFrame:
    """Hits of the first QUERIES queries as records: id from the URL, title, description, score."""
    paths, title, texts = SHAPES[provider]
    found = F.coalesce(*[listed(payload, p, PAGE) for p in paths])
    r = F.col("r")
    rows = df.where(F.col(query_idx) < QUERIES).select(query_idx, *keep, F.posexplode(found).alias("pos", "r"))
    part = lambda c: F.nullif(F.concat_ws(" ", r[c]), F.lit("")) if c == "snippets" else r[c]
    description: Column = F.coalesce(*[part(c) for c in texts])
    if provider == "websearch":
        description = F.coalesce(description, F.lit(""))
    return rows.select(query_idx, *keep, "pos", F.concat(F.lit(f"{provider}-"), short_base64(r["url"])).alias("id"), r[title].alias("title"), description.alias("description"), r["url"].alias("url"), F.lit("active").alias("status"), F.lit(HIT_SCORE).alias("score"))
