"""What the plans of the core operators must and must not hold."""

import re

import pytest

from castgraph.plans import problems, reference


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_cooccurrence_is_an_equi_join(spark, small):
    text = plan(reference.QUERIES["cooc_window15"](spark, small))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python|Arrow", text)
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", ["p3_acts", "p3_found"])
def test_nested_records_stay_in_their_task(spark, small, name):
    text = plan(problems.QUERIES[name](spark, small))
    assert not re.search("Exchange|Python|Arrow", text) and "ReadSchema: struct<record_id:bigint,body:string>" in text


def test_filters_reach_the_scan(spark, small):
    text = plan(reference.QUERIES["clique_edges_merged"](spark, small))
    assert "IsNotNull(node1)" in text and "PushedFilters" in text


@pytest.mark.parametrize("name", ["order_clique_expansion", "metric_difference", "same_book_flag", "corpus_pair_cosines"])
def test_partial_aggregates_and_hash_joins(spark, small, name):
    text = plan(reference.QUERIES[name](spark, small))
    assert "CartesianProduct" not in text
