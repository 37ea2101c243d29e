"""The registry of procurement portals, and the searches and records made from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidweave.sources.registry import inline

#: Domain, name, state and tier of each portal, in the order in which they are tried.
PORTALS = [
    ("demandstar.com", "DemandStar", "National", 1),
    ("govtribe.com", "GovTribe", "National", 1),
    ("bidnetdirect.com", "BidNet Direct (Public)", "National", 1),
    ("periscopes2g.com", "Periscope S2G", "National", 1),
    ("publicpurchase.com", "Public Purchase", "National", 1),
    ("planetbids.com", "PlanetBids", "National", 1),
    ("ionwave.net", "IonWave eProcurement", "National", 1),
    ("caleprocure.ca.gov", "California eProcure", "CA", 2),
    ("txsmartbuy.gov", "Texas SmartBuy", "TX", 2),
    ("myfloridamarketplace.myflorida.com", "Florida Marketplace", "FL", 2),
    ("emaryland.maryland.gov", "eMaryland Marketplace", "MD", 2),
    ("procurement.pa.gov", "Pennsylvania eMarketplace", "PA", 2),
    ("commerce.ohio.gov", "Ohio Procurement", "OH", 2),
    ("gears.illinois.gov", "Illinois GEARS", "IL", 2),
    ("gab.georgia.gov", "Georgia Bids & Contracts", "GA", 2),
    ("webs.wa.gov", "Washington WEBS", "WA", 2),
    ("bids.nc.gov", "NC eProcurement", "NC", 2),
    ("bids.az.gov", "Arizona ProcureAZ", "AZ", 3),
    ("bidexpress.com", "Bid Express", "National", 3),
    ("co.colorado.gov", "Colorado BIDS", "CO", 3),
    ("michigan.gov", "Michigan SIGMA", "MI", 3),
    ("nj.gov", "New Jersey Division of Purchase", "NJ", 3),
    ("doa.virginia.gov", "Virginia eVA", "VA", 3),
    ("tn.gov", "Tennessee Central Procurement", "TN", 3),
]
#: What portals are searched for; {year} is the present one.
TERMS = [
    "occupational health services RFP solicitation {year}",
    "pre-employment drug testing screening government contract {year}",
    "employee health wellness clinic services bid {year}",
    "occupational medicine DOT physical services procurement {year}",
    "workers compensation medical services contract {year}",
]
KEYWORD_TERM = '"{keywords}" RFP OR solicitation OR bid {year}'


def portals(spark: SparkSession) -> DataFrame:
    """(pos, domain, name, state, tier), one row per portal."""
    return inline(spark, "pos int, domain string, name string, state string, tier int", [(i, *row) for i, row in enumerate(PORTALS)])


def searches_of(requests: DataFrame, keywords: str, year: str, with_third: bool = False) -> DataFrame:
    """The searches of each request, beside its columns: batch, term, query. Its keywords over all portals come first (batch 0), if it has any, then every
    term for the portals of each tier. The searches, some fifteen for any request, are constants."""
    known = portals(requests.sparkSession).where(F.lit(with_third) | (F.col("tier") < 3))
    sites = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "domain"))), lambda p: F.concat(F.lit("site:"), p["domain"])), " OR ")
    own = known.agg(F.lit(0).alias("batch"), sites.alias("sites"), F.array(F.lit(KEYWORD_TERM)).alias("terms"))
    batches = own.unionByName(known.groupBy(F.col("tier").alias("batch")).agg(sites.alias("sites"), F.array(*[F.lit(t) for t in TERMS]).alias("terms")))
    rows = batches.select("batch", F.concat(F.lit("("), "sites", F.lit(") ")).alias("sites"), F.posexplode("terms").alias("term", "text"))
    listed = rows.agg(F.collect_list(F.struct("batch", "term", "sites", "text"))).scalar()
    asked = F.trim(F.coalesce(F.col(keywords), F.lit("")))
    each = requests.withColumn("_s", F.explode(listed)).where((F.col("_s.batch") > 0) | (asked != ""))
    text = F.replace(F.replace(F.col("_s.text"), F.lit("{keywords}"), asked), F.lit("{year}"), F.col(year).cast("string"))
    return each.select(*requests.columns, "_s.batch", "_s.term", F.concat("_s.sites", text).alias("query"))


def searches(spark: SparkSession, year: Column, keywords: str | None = None, with_third: bool = False) -> DataFrame:
    """(batch, term, query) of one request."""
    request = spark.range(1).select(F.lit(keywords).cast("string").alias("_keywords"), year.alias("_year"))
    return searches_of(request, "_keywords", "_year", with_third).select("batch", "term", "query")


def portal_of(url: Column, part: str = "name", default: str = "State Portal") -> Column:
    """Name (or state) of the first portal whose domain the URL's host contains."""
    host = F.regexp_extract(url, r"https?://([^/]+)", 1)
    known = F.array(*[F.struct(F.lit(d).alias("domain"), F.lit(n).alias("name"), F.lit(s).alias("state")) for d, n, s, _ in PORTALS])
    found = F.transform(F.array(host), lambda h: F.try_element_at(F.filter(known, lambda p: F.contains(h, p["domain"])), F.lit(1))[part])
    return F.coalesce(F.get(found, F.lit(0)), F.lit(default))
