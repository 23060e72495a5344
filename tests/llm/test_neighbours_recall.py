import numpy as np

from castgraph.llm import neighbours


def blobs(seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((400, 24))[rng.integers(0, 400, 6000)] + 0.45 * rng.standard_normal((6000, 24))
    return neighbours._unit(x).astype(np.float32)


def test_visits_reach_098_of_the_neighbours():
    for seed in range(3):
        x = blobs(seed)
        tree = neighbours.Tree.fit(x, len(x) * 10)
        tree.calibrate(x, 5, 0.75)
        at = np.linspace(0, len(x) - 1, 1500).astype(int)
        s = x[at] @ x.T
        s[np.arange(len(at)), at] = -2
        best = np.argsort(-s, axis=1)[:, :5]
        near = np.take_along_axis(s, best, 1) >= 0.75
        seen = tree.visit(x[at], tree.visits)
        hit = (tree.visit(x, 1)[:, 0][best][:, :, None] == seen[:, None, :]).any(2)
        assert tree.visits > neighbours.LEAST_VISITS and hit[near].mean() >= 0.98
