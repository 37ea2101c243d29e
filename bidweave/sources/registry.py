"""Inline dimensions, templates, configuration and the registry of sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUILDERS: dict[str, Callable[..., DataFrame]] = {}


def source(name: str):
    """Registers a source builder under a name."""

    def add(build):
        BUILDERS[name] = build
        return build

    return add


def inline(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    """A small constant table, built in the JVM."""
    names = [part.strip().split()[0] for part in schema.split(",")]
    kinds = [part.strip().split()[1] for part in schema.split(",")]
    structs = F.array(*[F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(row, names, kinds)]) for row in rows])
    return spark.range(1).select(F.explode(structs).alias("r")).select("r.*")


#: States by code with region and OSHA plan.
STATES = [
    ("AL", "Alabama", "Southeast", "federal"),
    ("AK", "Alaska", "West", "full"),
    ("AZ", "Arizona", "Southwest", "full"),
    ("AR", "Arkansas", "South", "federal"),
    ("CA", "California", "West", "full"),
    ("CO", "Colorado", "Mountain", "federal"),
    ("CT", "Connecticut", "Northeast", "public_only"),
    ("DE", "Delaware", "Mid-Atlantic", "public_only"),
    ("FL", "Florida", "Southeast", "federal"),
    ("GA", "Georgia", "Southeast", "federal"),
    ("HI", "Hawaii", "Pacific", "full"),
    ("ID", "Idaho", "Mountain", "full"),
    ("IL", "Illinois", "Midwest", "public_only"),
    ("IN", "Indiana", "Midwest", "full"),
    ("IA", "Iowa", "Midwest", "federal"),
    ("KS", "Kansas", "Midwest", "federal"),
    ("KY", "Kentucky", "South", "full"),
    ("LA", "Louisiana", "South", "federal"),
    ("ME", "Maine", "Northeast", "public_only"),
    ("MD", "Maryland", "Mid-Atlantic", "full"),
    ("MA", "Massachusetts", "Northeast", "federal"),
    ("MI", "Michigan", "Midwest", "full"),
    ("MN", "Minnesota", "Midwest", "full"),
    ("MS", "Mississippi", "South", "federal"),
    ("MO", "Missouri", "Midwest", "federal"),
    ("MT", "Montana", "Mountain", "federal"),
    ("NE", "Nebraska", "Midwest", "federal"),
    ("NV", "Nevada", "West", "full"),
    ("NH", "New Hampshire", "Northeast", "federal"),
    ("NJ", "New Jersey", "Mid-Atlantic", "public_only"),
    ("NM", "New Mexico", "Southwest", "full"),
    ("NY", "New York", "Northeast", "public_only"),
    ("NC", "North Carolina", "Southeast", "full"),
    ("ND", "North Dakota", "Midwest", "federal"),
    ("OH", "Ohio", "Midwest", "federal"),
    ("OK", "Oklahoma", "South", "federal"),
    ("OR", "Oregon", "West", "full"),
    ("PA", "Pennsylvania", "Mid-Atlantic", "public_only"),
    ("RI", "Rhode Island", "Northeast", "federal"),
    ("SC", "South Carolina", "Southeast", "full"),
    ("SD", "South Dakota", "Midwest", "federal"),
    ("TN", "Tennessee", "Southeast", "full"),
    ("TX", "Texas", "South", "federal"),
    ("UT", "Utah", "Mountain", "full"),
    ("VT", "Vermont", "Northeast", "full"),
    ("VA", "Virginia", "Mid-Atlantic", "full"),
    ("WA", "Washington", "West", "full"),
    ("WV", "West Virginia", "Mid-Atlantic", "federal"),
    ("WI", "Wisconsin", "Midwest", "federal"),
    ("WY", "Wyoming", "Mountain", "full"),
    ("DC", "Washington D.C.", "Mid-Atlantic", "federal"),
]
STATE_CODES = [code for code, *_ in STATES]
#: Countries that a location can be in.
COUNTRIES = [
    "United States", "United Kingdom", "Germany", "France", "Australia", "Canada", "Japan", "Italy", "Spain", "Netherlands", "Belgium", "Sweden", "Norway", "Denmark", "Finland", "Poland", "Czech Republic",
    "Romania", "Hungary", "Austria", "Switzerland", "Portugal", "Greece", "Turkey", "Israel", "Saudi Arabia", "UAE", "Qatar", "Kuwait", "Bahrain", "India", "China", "South Korea", "Singapore", "Malaysia", "Thailand",
    "Philippines", "Indonesia", "Brazil", "Mexico", "Colombia", "Argentina", "Chile", "South Africa", "Egypt", "Nigeria", "Kenya", "Morocco", "Algeria", "Pakistan", "Bangladesh", "Vietnam", "Taiwan",
    "New Zealand", "Ireland", "Luxembourg", "Slovakia", "Croatia", "Slovenia", "Estonia", "Latvia", "Lithuania",
]


def states(spark: SparkSession) -> DataFrame:
    return inline(spark, "state_code string, state_name string, region string, osha_state_plan string", STATES)


def seeded(state: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    """The state with the seed rows that it lacks."""
    return state.unionByName(seed.join(state.select(key), key, "left_anti"))


def expanded(templates: DataFrame, dimension: DataFrame, template: str, marks: dict[str, str]) -> DataFrame:
    """Every template for every row of a dimension, with the marks replaced by its columns.

    The templates, a few by nature, are one array beside each row of the dimension."""
    listed = templates.agg(F.collect_list(F.struct(*templates.columns)).alias("t")).scalar()
    rows = dimension.withColumn("_t", F.explode(listed)).select(*dimension.columns, "_t.*")
    text: Column = F.col(template)
    for mark, column in marks.items():
        text = F.replace(text, F.lit(mark), F.col(column))
    return rows.withColumn("query", text)


def setting(db: DataFrame, env: DataFrame) -> DataFrame:
    """(key, value): the stored value, or else the environment's; blank counts as missing."""
    d, e = db.select("key", F.col("value").alias("_d")), env.select("key", F.col("value").alias("_e"))
    return d.join(e, "key", "full_outer").select("key", F.coalesce(F.nullif("_d", F.lit("")), F.nullif("_e", F.lit(""))).alias("value"))


def provider_status(providers: DataFrame, counts: DataFrame, key: str) -> DataFrame:
    """Providers with the number of their records, 0 where they have none."""
    return providers.join(counts, key, "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint"))


def site_query(portals: DataFrame, group: str, site: str, topic: str) -> DataFrame:
    """One query per group: its sites joined by OR, then the topic. A group's portals are few by nature."""
    sites = F.array_join(F.transform(F.array_sort(F.collect_list(site)), lambda s: F.concat(F.lit("site:"), s)), " OR ")
    return portals.groupBy(group).agg(F.concat(sites, F.lit(f" {topic}")).alias("query"))


def unavailable(spark: SparkSession, name: str, message: str) -> tuple[DataFrame, DataFrame]:
    """A source that can't be asked: no rows of the canonical shape, and one error row (source, message)."""
    from bidweave.schemas import CANONICAL

    rows = spark.createDataFrame([], CANONICAL)
    return rows, inline(spark, "source string, message string", [(name, message)])


def source_errors(requests: DataFrame, source: str, stubs: dict[str, str]) -> DataFrame:
    """The requests to sources that can't be asked, each with the source's message; requests to other sources have no error."""
    known = inline(requests.sparkSession, f"{source} string, message string", list(stubs.items()))
    return requests.join(known, source)
