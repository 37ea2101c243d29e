"""Indexed pattern search against the scan that it replaces."""

from __future__ import annotations

import random
import re

import pytest

from bidweave.operators import text_index
from bidweave.operators.filters import any_ilike

from .test_plans import plan

TERMS = ["bolt", "d b", "re", "", "r_d", "red%ring", "RED", "ed\\_b", "\\%", "no such term", "é😀x", "ring ring ring", "a_b%c", "Ärger", "___", "large ring and more of it"]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    draw = random.Random(2)
    words = ["red", "bolt", "ring", "Red_b", "%", "é😀x", "ärger", "a", "large", "and", "more of it"]
    rows = [(i, *[" ".join(draw.choice(words) for _ in range(draw.randrange(5))) if draw.random() < 0.9 else None for _ in range(2)]) for i in range(400)] + [(7, "red bolt again", "x" * 20_000), (None, "red bolt of no key", None)]
    frame = spark.createDataFrame(rows, "id int, a string, b string")
    return frame, text_index.build(frame, "id", ["a", "b"], str(tmp_path_factory.mktemp("index")) + "/t", shelves=8, slices=8)


@pytest.mark.parametrize("term", TERMS)
def test_search_equals_a_scan(spark, index, rows_of, term):
    frame, known = index
    condition = any_ilike(term, "a", "b")
    want = frame if condition is None else frame.where(condition)
    assert rows_of(text_index.search(spark, known, term)) == rows_of(want)


def test_only_some_files_are_read(spark, index):
    said = plan(text_index.search(spark, index[1], "red_bolt"))
    assert re.search(r"PartitionFilters: \[.*_shelf#\d+ IN", said) and "In(gram, [" in said
    shelves = {text_index.shelf_of(g, 8) for g in text_index.wanted("red_bolt")}
    assert len(shelves) < 8 and text_index.wanted("red_bolt") == ["bol", "olt", "red"]
    assert "dynamicpruning" in said  # of the slices of rows


def test_an_empty_table(spark, tmp_path):
    empty = text_index.build(spark.createDataFrame([], "id int, a string"), "id", ["a"], str(tmp_path / "t"))
    for part in ("rows", "postings"):
        assert (tmp_path / "t" / part / "_SUCCESS").exists()
    assert empty.columns == ("a",)
