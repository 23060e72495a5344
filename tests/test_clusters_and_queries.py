"""Cluster labels next to nulls, ranks, and queries without SQL by their values."""

import pytest

from castgraph.operators import cluster
from castgraph.plans import reference


def test_dbscan_keeps_rows_without_a_value(spark):
    rows = [("p", 1, 1.0), ("p", 2, 1.5), ("p", 3, None), (None, 4, 1.0), (None, 5, None), ("p", 6, 90.0)]
    df = spark.createDataFrame(rows, "play string, i int, x double")
    got = {(r.play, r.i): (r.x, r.cluster) for r in cluster.dbscan_1d(df, "x", 1.0, 2, ["play"]).collect()}
    assert got == {("p", 1): (1.0, 0), ("p", 2): (1.5, 0), ("p", 3): (None, None), (None, 4): (1.0, -1), (None, 5): (None, None), ("p", 6): (90.0, -1)}
    assert cluster.dbscan_1d(df, "x", 1.0, 2, ["play"]).columns == ["play", "i", "x", "cluster"]


def test_ranks_of_centres(spark):
    df = spark.createDataFrame([("a", 3.0), ("b", 1.0), ("c", 3.0), ("d", 9.0)], "name string, centre double")
    assert {r.name: r.cluster for r in cluster.rank_labels(df).collect()} == {"a": 1, "b": 0, "c": 1, "d": 2}


def test_context_vectors_are_means(spark, small):
    df = reference.QUERIES["context_vectors"](spark, small)
    rows = df.groupBy("lang", "entity").count().collect()
    assert rows and all(r["count"] == 64 for r in rows)


def test_variance_shares(spark, small):
    shares = [r.ratio for r in reference.QUERIES["pca_variance"](spark, small).orderBy("component").collect()]
    assert len(shares) == 3 and shares == sorted(shares, reverse=True) and 0 < sum(shares) < 1


def test_speeches_follow_their_scenes(spark, small):
    rows = reference.QUERIES["tei_speeches"](spark, small).collect()
    seen = {}
    for r in rows:
        seen.setdefault((r.record_id, r.scene_idx), []).append(r.speech_idx)
    assert rows and all(sorted(v) == list(range(len(v))) for v in seen.values())


def test_kmeans_query_orders_its_clusters(spark, small):
    rows = reference.QUERIES["cluster_pairs_kmeans1d"](spark, small).collect()
    by_value = sorted((r.value, r.cluster) for r in rows)
    assert [c for _, c in by_value] == sorted(c for _, c in by_value)


@pytest.mark.parametrize("name", ["entity_contexts", "metric_difference"])
def test_plans_hold_no_cross_join_and_few_scans(spark, small, name):
    plan = reference.QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and (name != "entity_contexts" or plan.count("FileScan parquet") == 1)
