"""How a query and its SQL counterpart are held together."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[["Tables"], DataFrame]


class Tables:
    """The tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    """build(spark, sf_dir) makes the result; oracle is DuckDB SQL over the same tables; covers: inventory ids."""

    name: str
    make: Build
    oracle: str | None
    covers: tuple[str, ...]

    def build(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.make(Tables(spark, sf_dir))


QUERIES: dict[str, Query] = {}


def query(covers: str, oracle: str | None = None):
    """Registers a function of Tables as a query of its own name."""

    def add(make: Build) -> Build:
        QUERIES[make.__name__] = Query(make.__name__, make, oracle, tuple(covers.split()))
        return make

    return add


def case_sql(text: str, rules: list[tuple[str, list[str]]], default: str | None) -> str:
    """The CASE of a rule table in SQL."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    whens = " ".join(f"WHEN {any_sql(text, needles)} THEN {quote(label)}" for label, needles in rules)
    return f"(CASE {whens} ELSE {'NULL' if default is None else quote(default)} END)"


def any_sql(text: str, needles: list[str]) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, n.replace("'", "''")) for n in needles) + ")"
