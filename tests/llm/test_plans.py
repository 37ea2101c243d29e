"""Native operators run no Python; Python ones run nothing else row by row."""

from __future__ import annotations

import re

import pytest

from bidweave.llm import catalog

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@pytest.mark.parametrize("name", ["op5_decontaminate", "op6_chat_format", "op7_exact_dedup", "op10_secret_scan"])
def test_native_operators_have_no_python(spark, name):
    assert not re.search(r"Python|Pandas|Arrow", plan(catalog.queries()[name](spark, SF)))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_no_products_and_no_row_functions(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", plan(catalog.queries()[name](spark, SF)))


def test_copies_meet_before_the_shuffle(spark):
    said = plan(catalog.queries()["op7_exact_dedup"](spark, SF))
    assert "partial_max" in said and "partial_count" in said
