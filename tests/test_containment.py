"""Containment joins against plain Python."""

from __future__ import annotations

import random
import re

import pytest

from bidweave.operators import containment, joins
from bidweave.plans.catalog import QUERIES

from .test_plans import SF, plan

TEXTS = [None, "", "   ", "the city of new york and albany", "newyork", "xnew yorkx", "new  york", "albany\tcounty", "a", "é😀b", "word " * 5000 + "needle end", "n" * 50_000 + "eedle", "same", "same", "same"]
PLACES = [(5, "new york", "york", "p5"), (2, "albany", "", "p2"), (2, "albany", "x", "p1"), (7, None, "a", "p7"), (9, " ", "  ", "p9"), (11, "needle", "e", "p11"), (12, "😀", None, "p12"), (1, "needle end", "", "p0"), (3, "absent word", "zz", "p3")]


def brute(text):
    named = [(o, i, c, s) for o, c, s, i in PLACES]
    if text is None:
        return None
    cities = sorted((o, i) for o, i, c, _ in named if c and c.strip() and c in text)
    states = sorted((o, i) for o, i, _, s in named if s and s.strip() and s in text)
    return cities[0][1] if cities else states[-1][1] if states else None


def test_places_equal_brute_force(spark):
    draw = random.Random(3)
    texts = TEXTS + ["".join(draw.choice("ab eyn") for _ in range(draw.randrange(30))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    places = spark.createDataFrame(PLACES, "ordinal int, city string, state string, id string")
    got = {r["id"]: r["place_id"] for r in joins.contained_place(rows.withColumnRenamed("id", "key"), "t", places).withColumnRenamed("key", "id").select("id", "place_id").collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_no_places_and_no_texts(spark):
    rows = spark.createDataFrame([(1, "x")], "key int, t string")
    places = spark.createDataFrame(PLACES, "ordinal int, city string, state string, id string")
    assert [r["place_id"] for r in joins.contained_place(rows, "t", places.limit(0)).collect()] == [None]
    assert joins.contained_place(rows.limit(0), "t", places).count() == 0


def test_every_needle_of_every_text(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choice("abc ") for _ in range(40)) for _ in range(30)]
    needles = sorted({"".join(draw.choice("abc ") for _ in range(draw.randrange(1, 6))) for _ in range(80)})
    found = containment.containing(spark.createDataFrame([(t,) for t in texts], "t string"), "t", spark.createDataFrame([(n,) for n in needles], "n string"), "n")
    keyed = spark.createDataFrame([(t,) for t in set(texts)], "t string").withColumn("fingerprint", containment.fingerprint("t"))
    assert {(r["t"], r["n"]) for r in found.join(keyed, "fingerprint").collect()} == {(t, n) for t in texts for n in needles if n.strip() and n in t}


def test_a_hundred_thousand_needles(spark):
    """All of them at once, which comparing each with each would not allow."""
    import time

    needles = spark.range(100_000).selectExpr("CAST(id AS INT) AS ordinal", "concat('portal', lpad(id, 6, '0'), '.gov') AS domain", "concat('P', id) AS name")
    hosts = spark.range(20_000).selectExpr("id AS key", "concat('www.portal', lpad(id * 7, 6, '0'), '.gov') AS h")
    start = time.monotonic()
    got = joins.first_match(hosts, "h", needles, "none").where("portal = IF(key * 7 < 100000, concat('P', key * 7), 'none')").count()
    assert got == 20_000 and time.monotonic() - start < 120


@pytest.mark.parametrize("name", ["text_contains_join", "first_match_dimension", "mention_join", "portal_index"])
def test_no_dimension_in_one_row(spark, name):
    said = plan(QUERIES[name].build(spark, SF))
    assert not re.search(r"[Ss]calar-?[Ss]ubquery|collect_list|NestedLoop|Cartesian", said)
