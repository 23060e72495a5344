"""Near passages against brute force, and the recall at two edits."""

import random

import numpy as np
import pytest

from castgraph.llm import leaks


def distance(x, y):
    d = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, d[0] = d[0], i
        for j, b in enumerate(y, 1):
            last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (a != b))
    return d[-1]


def test_near_against_brute_force(spark):
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([4, 7, 10, 18])))) for i in range(30)]
    docs = []
    for d in range(120):
        body = rng.choices(vocabulary, k=30)
        words = items[rng.randrange(30)][1].split()
        k = rng.randrange(len(words))
        words[k : k + 1] = rng.choice([[], ["other"], [words[k], "more"], [words[k]]])
        body[7:7] = words
        docs.append((d, " ".join(body)))
    want = {}
    for d, text in docs:
        w = text.split()
        for i, item in items:
            v = item.split()
            n = min(10, len(v))
            least = min(distance(w[a : a + m], v[b : b + n]) for b in range(len(v) - n + 1) for m in (n - 1, n, n + 1) for a in range(len(w) - m + 1))
            if least <= 1:
                want[d, i] = least
    got = leaks.leaked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), spark, max_edits=1).collect()
    found = {(r.doc_id, r.item_id): r.edits for r in got}
    assert all(want[k] == v for k, v in found.items()) and len(found) >= 0.97 * len(want)


@pytest.mark.parametrize(("edits", "least"), [(1, 0.99), (2, 0.9)])
def test_recall_by_edits(edits, least):
    rng = np.random.default_rng(12)
    items = [[f"v{x}" for x in rng.integers(0, 5000, 10)] for _ in range(300)]
    index = leaks.Index(list(range(300)), [" ".join(i) for i in items], 10, edits)
    texts = []
    for item in items:
        w = list(item)
        for _ in range(edits):
            k = int(rng.integers(0, len(w)))
            w[k : k + 1] = [["other"], [], [w[k], "more"]][int(rng.integers(0, 3))]
        texts.append(" ".join(w))
    got = {(int(r[0]), int(r[1])) for r in index.matches(*leaks.words_of(texts))}
    assert np.mean([(k, k) in got for k in range(300)]) >= least


def test_short_items_keep_a_word():
    index = leaks.Index([1, 2], ["prospero", "miranda weeps"], 10, 1)
    got = {tuple(r[:2].tolist()) for r in index.matches(*leaks.words_of(["miranda laughs", "nobody here", "prospero"]))}
    assert got == {(0, 2), (2, 1)}


def test_index_in_blocks(spark, monkeypatch):
    items = [(i, " ".join(f"a{i}b{k}" for k in range(25))) for i in range(8)]
    docs = [(i, "x " + " ".join(t.split()[i : i + 12]) + " y") for i, t in items]
    D, I = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(leaks, "INDEX_BYTES", 15 * (8 * 12 + 12))  # 15 windows: every item is cut
    got = {(r.doc_id, r.item_id) for r in leaks.leaked(D, I, spark).collect()}
    assert got == {(i, i) for i in range(8)}
