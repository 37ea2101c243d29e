"""Feeds in text form (RSS) and their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tag(content: Column, name: str) -> Column:
    """Trimmed text of the first such tag, CDATA marks removed; null without the tag."""
    pattern = rf"(?is)<{name}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{name}>"
    return F.when(content.rlike(pattern), F.trim(F.regexp_extract(content, pattern, 1)))


def items(feeds: DataFrame, xml: str, keep: list[str], limit: int = 20) -> DataFrame:
    """The first ``limit`` items of each feed: position, title, description, link, published."""
    blocks = F.slice(F.regexp_extract_all(F.col(xml), F.lit(r"(?is)<item[^>]*>(.*?)</item>"), F.lit(1)), 1, limit)
    rows = feeds.select(*keep, F.posexplode(blocks).alias("pos", "_b"))
    b = F.col("_b")
    return rows.select(
        *keep,
        (F.col("pos") + 1).alias("pos"),
        F.coalesce(tag(b, "title"), F.lit("Untitled")).alias("title"),
        F.coalesce(tag(b, "description"), tag(b, "summary")).alias("description"),
        F.coalesce(tag(b, "link"), tag(b, "guid")).alias("link"),
        F.coalesce(tag(b, "pubDate"), tag(b, "dc:date"), tag(b, "published")).alias("published"),
    )


#: Relevance patterns of the feeds.
AVIATION = r"(?i)medical|health|ame|aviation medicine|pilot|physical|flight surgeon|occupational"
HIGH_ADVISORY = r"(?i)level [34]|do not travel|reconsider"


def relevant(rows: DataFrame, pattern: str) -> DataFrame:
    """Items whose title or description matches."""
    return rows.where(F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit(""))).rlike(pattern))


def advisories(rows: DataFrame) -> DataFrame:
    """Travel advisories: region from the title, score and tag by level."""
    high = F.concat_ws(" ", F.col("title"), F.coalesce("description", F.lit(""))).rlike(HIGH_ADVISORY)
    return rows.withColumns({"region": F.trim(F.regexp_replace("title", r"(?i)- Level.*$", "")), "score": F.when(high, 75).otherwise(45), "tag": F.when(high, "brief").otherwise("monitor")})


def title_country(title: Column) -> Column:
    """What stands before the first dash of a title."""
    return F.trim(F.regexp_extract(title, r"^([^-–]+)", 1))
