"""What the physical plans must have, and must not have."""

from __future__ import annotations

import re

import pytest

from bidweave.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# registry_dimensions joins constants of two rows, which Spark folds into a loop.
@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"registry_dimensions"}))
def test_no_products_and_no_python(spark, name):
    said = plan(QUERIES[name].build(spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|Python|Pandas|Arrow(Eval|Map)", said)


def test_filters_and_columns_reach_the_scan(spark):
    said = plan(QUERIES["optional_filters"].build(spark, SF))
    assert "EqualTo(o_orderstatus,F)" in said
    assert re.search(r"ReadSchema: struct<o_orderkey:bigint,o_orderstatus:string,o_orderpriority:string>", said)
    assert "EqualTo(c_custkey,42)" in plan(QUERIES["point_lookup"].build(spark, SF))
    assert "ReadSchema: struct<url:string>" in plan(QUERIES["host_counts"].build(spark, SF))


@pytest.mark.parametrize("name", ["group_topn", "percent_split", "hiring_level", "votes_majority", "host_counts", "quarter_timeline"])
def test_groups_are_reduced_before_the_shuffle(spark, name):
    assert "partial_" in plan(QUERIES[name].build(spark, SF))


@pytest.mark.parametrize("name", ["search_page", "discovery_pipeline", "first_n_matches", "multi_key_topk"])
def test_pages_are_a_top_k(spark, name):
    said = plan(QUERIES[name].build(spark, SF))
    assert "TakeOrderedAndProject" in said or re.search(r"GlobalLimit|CollectLimit", said)
