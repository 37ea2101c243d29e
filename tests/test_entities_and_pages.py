"""Similar names against all pairs; deep pages against sorted lists."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from bidweave.functions.text import company_core
from bidweave.operators import entities, filters, pages
from tests.test_plans import plan

SF = "/root/testdata/sf0.01"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        corner, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
    return row[-1]


def spelled(rng, name):
    name = list(name)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(name) + 1)
        how = rng.randrange(3)
        name[at : at + (how > 0)] = [] if how == 1 else [rng.choice("abé ")]
    return "".join(name)


@pytest.mark.parametrize("percent", [70, 85, 95, 100])
def test_all_similar_names_are_found(spark, percent):
    rng = random.Random(percent)
    base = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(1, 24))) for _ in range(25)]
    names = sorted({spelled(rng, b) for b in base for _ in range(4)} | {"aaaaaaaaaaaaaaaa", "aaaaaaaaaaaaaaa", "a", "ab"})
    df = spark.createDataFrame([(n,) for n in [*names, *names, None, ""]], "name string")
    got = {tuple(r) for r in entities.similar(df, df.withColumnRenamed("name", "alias"), percent).collect()}
    want = {(a, b, e) for a in names for b in names if a and b and 100 * (e := edits(a, b)) <= (100 - percent) * max(len(a), len(b))}
    assert got == want


def test_companies_meet_their_aliases(spark):
    rows = spark.createDataFrame([(1, "The Northwind Traders Inc"), (2, "Nothwind Traders, LLC"), (3, "Northwind Trader"), (4, "Contoso"), (5, None), (6, ""), (1, "The Northwind Traders Inc")], "id int, raw string")
    dimension = spark.createDataFrame([(20, ["Northwind Traders"]), (10, ["other", " northwind traders "]), (30, ["Northwind Traderz"]), (40, None)], "client int, aliases array<string>")
    out = entities.by_similar_alias(rows.withColumn("name", company_core("raw")), "name", dimension, "aliases", "client")
    assert sorted((r["id"], r["client"]) for r in out.collect()) == [(1, 20), (1, 20), (2, 20), (3, 20), (4, None), (5, None), (6, None)]
    assert entities.by_similar_alias(rows.withColumn("name", company_core("raw")).limit(0), "name", dimension, "aliases", "client").count() == 0


def test_commonest_spelling_stands_for_a_name(spark):
    rows = spark.createDataFrame([(n,) for n in ["acme holdings"] * 3 + ["acme holding", "acme holdngs", "zeta", None]], "name string")
    out = {r["name"]: (r["entity"], r["n_similar"]) for r in entities.resolved(rows, "name").collect()}
    assert out == {"acme holdings": ("acme holdings", 3), "acme holding": ("acme holdings", 2), "acme holdngs": ("acme holdings", 2), "zeta": ("zeta", 1), None: (None, None)}


ORDER = [("o_totalprice", True), ("o_orderkey", False)]


def test_pages_equal_those_of_a_full_sort(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    stored = pages.store(orders, ORDER, str(tmp_path / "orders"), ranges=16)
    assert stored.total == orders.count() and len(stored.before) == 17
    last = -(-stored.total // 50)
    for number in (1, 2, 20, last // 2, last, last + 1):
        want = filters.page(orders, [F.desc("o_totalprice"), F.asc("o_orderkey")], number=number)
        got = pages.page_at(spark, stored, number=number)
        assert got.schema.simpleString() == want.schema.simpleString()
        assert [tuple(r) for r in got.orderBy("pos").collect()] == [tuple(r) for r in want.orderBy("pos").collect()], number


def test_a_page_reads_the_ranges_that_it_lies_in(spark, tmp_path):
    orders = spark.read.parquet(f"{SF}/orders.parquet").select("o_orderkey", "o_totalprice")
    stored = pages.store(orders, ORDER, str(tmp_path / "orders"), ranges=16)
    deep = pages.page_at(spark, stored, number=stored.total // 50)
    deep.collect()
    assert re.search(r"PartitionFilters: \[.*_range", plan(deep))
    assert len({r["_range"] for r in spark.read.parquet(stored.folder).join(deep.select("o_orderkey"), "o_orderkey").select("_range").collect()}) <= 2


def test_following_pages_by_the_last_row_gives_every_row_once(spark):
    rows = spark.createDataFrame([(i, float(i % 7)) for i in range(60)], "o_orderkey long, o_totalprice double")
    seen, last = [], [9.0, -1]
    while page := pages.page_after(rows, ORDER, last, size=17).collect():
        seen += [(r["o_totalprice"], r["o_orderkey"]) for r in page]
        last = list(seen[-1])
    assert seen == sorted(((float(i % 7), i) for i in range(60)), key=lambda r: (-r[0], r[1]))


def test_pages_of_ties_nulls_and_nothing(spark, tmp_path):
    rows = spark.createDataFrame([(i, None if i % 3 else 1.0) for i in range(30)], "o_orderkey long, o_totalprice double")
    stored = pages.store(rows, ORDER, str(tmp_path / "ties"), ranges=4)
    got = [r["o_orderkey"] for n in (1, 2, 3) for r in pages.page_at(spark, stored, n, 12).orderBy("pos").collect()]
    assert got == sorted(range(30), key=lambda i: (i % 3 > 0, i))
    empty = pages.store(rows.limit(0), ORDER, str(tmp_path / "none"), ranges=4)
    assert empty.total == 0 and pages.page_at(spark, empty).count() == 0
