"""Expansions of hyperedges, cast links and play types: O-08 and its data model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def star_expansion(members: DataFrame) -> DataFrame:
    """(edge, node): one row per node of a hyperedge."""
    return members.select("edge", "node").dropna().distinct()


def clique_expansion(members: DataFrame) -> DataFrame:
    """(node1, node2, count): in how many hyperedges a pair of nodes meets. Sets are unrolled node by node."""
    sets = members.select("edge", "node").dropna().groupBy("edge").agg(F.sort_array(F.collect_set("node")).alias("nodes"))
    same = sets.groupBy("nodes").agg(F.count(F.lit(1)).alias("n"))
    first = same.select("nodes", "n", F.posexplode("nodes").alias("k", "node1"))
    return first.select("node1", "n", F.explode(F.slice("nodes", F.col("k") + 2, F.size("nodes"))).alias("node2")).groupBy("node1", "node2").agg(F.sum("n").alias("count"))


def node_totals(members: DataFrame, weights: list[str]) -> DataFrame:
    """Sums of a hyperedge's weights per node."""
    return members.groupBy("node").agg(*(F.sum(w).alias(w) for w in weights))


def merged_clique_edges(edges: DataFrame) -> DataFrame:
    """(play, node1, node2, count): published edges with one orientation; of repeats the greatest count; null nodes and counts are left out."""
    return edges.filter("node1 IS NOT NULL AND node2 IS NOT NULL AND count IS NOT NULL").groupBy("play", F.least("node1", "node2").alias("node1"), F.greatest("node1", "node2").alias("node2")).agg(F.max("count").alias("count"))


def cast_links(cast: DataFrame) -> DataFrame:
    """(play, xml_id, parent, relation): distinct links of the cast list; members of a group (corresp) and doublets (same_as)."""
    links = cast.select("play", "xml_id", F.expr("stack(2, 'corresp', corresp, 'same_as', same_as) AS (relation, parent)"))
    return links.filter("parent IS NOT NULL").select("play", "xml_id", F.regexp_replace("parent", "^#", "").alias("parent"), "relation").distinct()


def play_types(types: DataFrame) -> DataFrame:
    """(play_type, n_plays): tidy types; null ones together."""
    tidy = F.nullif(F.lower(F.trim("play_type")), F.lit(""))
    one = types.groupBy("play_name").agg(F.max(tidy).alias("play_type"))
    return one.groupBy("play_type").agg(F.count(F.lit(1)).alias("n_plays"))
