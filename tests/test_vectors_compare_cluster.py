import numpy as np
import pytest
from pyspark.sql import functions as F

from castgraph.operators import cluster, compare, embed, vectors


def pairs(spark, rows):
    return spark.createDataFrame(rows, "char1 string, char2 string, value double")


def test_self_pair_and_dedup(spark):
    e = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [1.0, 1.0]), ("a", 2, [1.0, 0.0]), ("c", 3, None)], "name string, k int, vec array<double>")
    got = {(r.char1, r.char2): round(r.value, 6) for r in vectors.dedup_pairs(vectors.pair_similarities(e, ["k"])).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): round(0.5**0.5, 6)}


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).first().x is None
    assert df.select(vectors.cosine(F.col("a"), F.col("b"), 0.0).alias("x")).first().x == 0.0


def test_difference_and_wide(spark):
    left, right = pairs(spark, [("a", "b", 4.0), ("a", "c", 2.0)]), pairs(spark, [("b", "a", 0.25), ("x", "y", 1.0)])
    assert [tuple(r) for r in compare.difference(left, right).collect()] == [("a", "b", 0.75)]
    wide = {(r.char1, r.char2): (r.cooc, r.w2v, r.cooc_cluster) for r in compare.compare_wide({"cooc": left, "w2v": right}).collect()}
    assert wide == {("a", "b"): (4.0, 0.25, 0), ("a", "c"): (2.0, 0.0, 0), ("x", "y"): (0.0, 1.0, 0)}


def test_heat_map_doubles_self_pairs(spark):
    got = {(r.row, r.col): r.value for r in compare.heat_map(pairs(spark, [("a", "a", 1.0), ("a", "b", 3.0)])).collect()}
    assert got == {("a", "a"): 2.0, ("a", "b"): 3.0, ("b", "a"): 3.0, ("b", "b"): 0.0}


def test_same_book_and_matrix(spark):
    lists = spark.createDataFrame([("p", "a"), ("p", "b"), ("q", "c"), ("q", "a")], "book string, name string")
    got = {(r.char1, r.char2): r.same_book for r in compare.same_book(pairs(spark, [("a", "b", 1.0), ("b", "c", 1.0)]), lists).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 0}
    assert {r.name: r.book for r in compare.entity_book(lists).collect()} == {"a": "q", "b": "p", "c": "q"}
    m = spark.createDataFrame([("p", "q", 1.0), ("q", "p", 3.0), ("p", "p", 5.0)], "book1 string, book2 string, value double")
    assert {(r.book_i, r.book_j): r["mean"] for r in compare.book_matrix(m).collect()} == {("p", "q"): 2.0, ("q", "p"): 2.0, ("p", "p"): 5.0, ("q", "q"): 0.0}


def brute_kmeans(values, k):
    from itertools import combinations

    v = sorted(values)
    best = (np.inf, None)
    for cuts in combinations(range(1, len(v)), k - 1):
        parts = np.split(np.array(v), cuts)
        best = min(best, (sum(((p - p.mean()) ** 2).sum() for p in parts), cuts))
    return best[0]


def test_exact_kmeans(spark):
    rng = np.random.default_rng(1)
    for _ in range(10):
        v = np.unique(rng.integers(0, 60, 11)).astype(float)
        label, centres = cluster.exact_kmeans_1d(v, np.ones(len(v)), 3)
        assert np.all(np.diff(label) >= 0) and np.isclose(((v - centres[label]) ** 2).sum(), brute_kmeans(v, 3))
    assert cluster.exact_kmeans_1d(np.array([7.0]), np.ones(1), 5)[1].tolist() == [0.9]
    rows = [("a", str(i), float(x)) for i, x in enumerate([1, 2, 50, 51, 90, 91])] + [("n", "n", None)]
    got = [r.cluster for r in cluster.cluster_values(pairs(spark, rows), 3).orderBy(F.asc_nulls_last("value")).collect()]
    assert got == [0, 0, 1, 1, 2, 2, None]


def test_dbscan(spark):
    rng = np.random.default_rng(2)
    v = [float(x) for x in rng.integers(0, 60, 40)]
    df = spark.createDataFrame([("g", i, x) for i, x in enumerate(v)], "g string, i int, x double")
    got = {r.i: r.cluster for r in cluster.dbscan_1d(df, "x", 2.0, 4, ["g"]).collect()}
    core = [sum(abs(a - b) <= 2 for b in v) >= 4 for a in v]
    for i, a in enumerate(v):
        if not core[i] and not any(core[j] and abs(a - v[j]) <= 2 for j in range(40)):
            assert got[i] == -1
        else:
            assert got[i] >= 0
    for i in range(40):
        for j in range(40):
            if core[i] and core[j] and abs(v[i] - v[j]) <= 2:
                assert got[i] == got[j]


def test_pca_matches_numpy(spark):
    x = np.random.default_rng(3).standard_normal((60, 5)) * [5, 3, 1, 1, 1] + 7
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, v array<double>")
    out, ratio = vectors.principal_components(df, "v", 2, ["i"])
    got = np.array([r.pc for r in out.orderBy("i").collect()])
    c = x - x.mean(0)
    _, s, vt = np.linalg.svd(c, full_matrices=False)
    assert np.allclose(np.abs(got), np.abs(c @ vt[:2].T)) and np.allclose(ratio, (s**2 / (s**2).sum())[:2])


def test_embedder_pooling(spark):
    df = spark.createDataFrame([("a b", ), (None,), ("",)], "t string")
    rows = [r.vec for r in embed.embed(df, "t").collect()]
    assert len(rows[0]) == 64 and rows[1] is None and rows[2] == [0.0] * 64
    with pytest.raises(ValueError):
        embed.embed(df, "t", pooling="max")
