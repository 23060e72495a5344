"""Queries of the general training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.operators.nested import flatten_plays
from castgraph.operators.packed import split_packed
from castgraph.sources import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten_plays(table(spark, d, "play_records"))["speakers"].drop("label")


def p3_table(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        return flatten_plays(table(spark, d, "play_records"))[name]

    return query


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return split_packed(table(spark, d, "hyperedges"), "row_id", "onstage", value="node").select("row_id", "pos", "node")


QUERIES = {"p3_found": p3_found, **{f"p3_{n}": p3_table(n) for n in ("acts", "scenes", "groups", "speeches", "speakers")}, "p5_found": p5_found}

#: The same rows by another way: JSON arrays are read as such, elsewhere an id runs from its first letter to its code.
SQL = {
    "p5_found": r"""
WITH ids AS (
  SELECT row_id, CASE WHEN onstage LIKE '[%' AND json_valid(onstage) THEN list_transform(from_json(onstage, '["VARCHAR"]'), lambda x: regexp_replace(trim(x), '^#', ''))
    ELSE list_transform(regexp_extract_all(onstage, '(?s).*?_[A-Z][a-z]{3}'), lambda x: replace(regexp_replace(x, '^[^\p{L}\p{N}]+', ''), '""', '"')) END AS nodes
  FROM hyperedges
)
SELECT row_id, generate_subscripts(nodes, 1)::INTEGER AS pos, unnest(nodes) AS node FROM ids"""
}
