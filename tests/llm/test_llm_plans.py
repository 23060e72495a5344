"""What the plans of the text operators must and must not hold."""

import re

import pytest

from castgraph.llm import queries


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["p2_pieces", "p6_ids", "p8_scores"])
def test_text_stays_in_its_task(spark, small, name):
    text = plan(queries.QUERIES[name](spark, small))
    assert "Exchange" not in text and "ReadSchema: struct<doc_id:bigint,text:string>" in text


@pytest.mark.parametrize("name", ["p1_found", "p4_found", "p7_found"])
def test_no_cross_join(spark, small, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(queries.QUERIES[name](spark, small)))
