"""Salted and cut cells, copies in hot classes, and the recall of the lists."""

import numpy as np
import pytest

from castgraph.llm import neighbours


def lists(spark, x, copies=()):
    rows = [(i, "w2v", v.tolist()) for i, v in enumerate(x)] + [(10_000 + i, "w2v", x[k].tolist()) for i, k in enumerate(copies)]
    df = spark.createDataFrame(rows, "vec_id long, space string, vec array<float>")
    return {(r.id, r.other) for r in neighbours.neighbours(df, spark, spaces={"w2v": x.shape[1]}).collect()}


def brute(x, ids):
    x = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    out = set()
    for i in range(len(x)):
        best = np.lexsort((ids, -s[i]))[:5]
        out |= {(int(ids[i]), int(ids[j])) for j in best if s[i, j] >= 0.75}
    return out


@pytest.mark.parametrize(("queries", "cell"), [(10**9, 500), (700, 500), (400, 10**9)])
def test_recall_of_the_lists(spark, monkeypatch, queries, cell):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((500, 24))[rng.integers(0, 500, 4000)] + 0.45 * rng.standard_normal((4000, 24))).astype(np.float32)
    for name, value in (("LEAF", 40), ("LEAST_CELL", cell), ("CELL", cell), ("MOST_QUERIES", queries), ("SAMPLE", 2000), ("MOST_SAMPLE", 2000), ("BATCH", 500)):
        monkeypatch.setattr(neighbours, name, value)
    want, got = brute(x, np.arange(4000)), lists(spark, x)
    assert len(got & want) >= 0.97 * len(want) and len(got - want) <= 0.03 * len(got)


def test_parts_of_a_hot_class(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "MEMBERS", 7)
    rng = np.random.default_rng(4)
    x = (rng.standard_normal((20, 8))[rng.integers(0, 20, 60)] + 0.2 * rng.standard_normal((60, 8))).astype(np.float32)
    copies = [3] * 40 + [5] * 2
    ids = np.array([*range(60), *(10_000 + i for i in range(42))])
    assert lists(spark, x, copies) == brute(np.concatenate([x, x[copies]]), ids)
