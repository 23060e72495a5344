"""Pair surprise on a group of 10**5 pairs, against exact tails and a plain ranking."""

import numpy as np
from pyspark.sql import functions as F

from castgraph.llm import pairs


def exact(k, q, m):
    """The upper tail of a sum of binomials by convolution."""
    d = np.ones(1)
    for qs, ms in zip(q, m, strict=True):
        for _ in range(int(ms)):
            d = np.convolve(d, [1 - qs, qs])
    return d[int(k) :].sum()


def test_a_large_group(spark):
    rng = np.random.default_rng(8)
    weight = 1 / np.arange(1, 601)
    rows = []
    for e in range(900):
        for i in rng.choice(600, min(600, int(rng.integers(2, 60))), replace=False, p=weight / weight.sum()):
            rows.append(("g", e, f"i{i:03d}"))
    df = spark.createDataFrame(rows, "g string, e int, i string")
    got = pairs.pair_surprise(df, "g", "e", "i").toPandas().sort_values("p_value", ignore_index=True)
    assert len(got) > 1e5
    sets = {}
    for _, e, i in rows:
        sets.setdefault(e, []).append(i)
    size, n_baskets = np.unique([len(s) for s in sets.values()], return_counts=True)
    count = {i: 0 for s in sets.values() for i in s}
    for s in sets.values():
        for i in s:
            count[i] += 1
    degree, n_items = np.unique(list(count.values()), return_counts=True)
    x, y = pairs.fit_bicm(degree, n_items, size, n_baskets)
    for r in got.iloc[np.linspace(0, len(got) - 1, 60).astype(int)].itertuples():
        q = pairs.probability(x[np.searchsorted(degree, r.c1)], y) * pairs.probability(x[np.searchsorted(degree, r.c2)], y)
        want = exact(r.c12, q, n_baskets)
        assert abs(r.expected - (q * n_baskets).sum()) < 1e-6 and abs(r.p_value - want) <= 0.12 * want + 1e-12
    tests = len(count) * (len(count) - 1) / 2
    # ties share the last rank
    rank = np.searchsorted(got.p_value, got.p_value, side="right")
    raw = np.minimum(1, got.p_value * tests / rank)
    assert np.allclose(got.q_value, np.minimum.accumulate(raw[::-1])[::-1])


def test_fit_with_many_kinds():
    rng = np.random.default_rng(9)
    degree = np.unique(np.round(np.exp(rng.uniform(0, np.log(9000), 4000))).astype(int))
    size = np.arange(1, 801)
    n_items, n_baskets = rng.integers(1, 5, len(degree)), rng.integers(1, 30, len(size))
    gap = (degree * n_items).sum() - (size * n_baskets).sum()
    n_baskets[0] += max(gap, 0)
    n_items[0] += max(-gap, 0)
    x, y = pairs.fit_bicm(degree, n_items, size, n_baskets)
    p = pairs.probability(x[:, None], y)
    assert np.allclose((p * n_baskets).sum(1), degree, rtol=1e-4) and np.allclose((p * n_items[:, None]).sum(0), size, rtol=1e-4)


def test_blocks_of_a_large_basket(spark, monkeypatch):
    monkeypatch.setattr(pairs, "BLOCK", 50)
    rows = [("p", "e", f"{i:03d}") for i in range(230)] + [("p", "f", f"{i:03d}") for i in range(40)] + [("p", f"h{k}", f"{i:03d}") for k in range(3) for i in range(51)]
    counts = pairs.pair_counts(spark.createDataFrame(rows, "g string, e string, i string"), "g", "e", "i")[2]
    want = {"n": 230 * 229 // 2, "s": 230 * 229 // 2 + 40 * 39 // 2 + 3 * 51 * 50 // 2}
    assert counts.agg(F.count(F.lit(1)).alias("n"), F.sum("c12").alias("s")).first().asDict() == want
