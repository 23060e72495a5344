import numpy as np
import pytest

from castgraph.operators import cluster


@pytest.mark.parametrize(("kind", "most"), [("pareto", 60), ("lognormal", 300), ("equal", 60)])
def test_exact_above_the_switch(spark, monkeypatch, kind, most):
    monkeypatch.setattr(cluster, "MOST_DISTINCT", most)
    rng = np.random.default_rng(5)
    v = {"pareto": rng.pareto(1.5, 3000), "lognormal": rng.lognormal(0, 1, 3000), "equal": np.arange(3000.0)}[kind]
    v = np.concatenate([v, v[:40]])
    distinct, counts = np.unique(v, return_counts=True)
    df = spark.createDataFrame([(float(x),) for x in v], "value double")
    got = {r.value: r.cluster for r in cluster.cluster_values(df, 5).collect()}
    label, _ = cluster.exact_kmeans_1d(distinct, counts.astype(float), 5)
    error = lambda of: sum((counts[of == c] * (distinct[of == c] - np.average(distinct[of == c], weights=counts[of == c])) ** 2).sum() for c in np.unique(of))
    mine = np.array([got[x] for x in distinct])
    assert np.all(np.diff(mine) >= 0) and len(np.unique(mine)) == 5
    assert np.isclose(error(mine), error(label), rtol=1e-9, atol=0)
