"""The operators of castgraph.llm against brute force, and their edge cases."""

import itertools
import random
import re
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from castgraph.llm import leaks, neighbours, pairs, pieces, queries, severity, tokens

VOCABULARY = f"{tokens.TOKENIZERS}/byte_bpe_50k"


# -- neighbours --------------------------------------------------------------------------------------------------


def brute_lists(rows, k=5, least=0.75):
    out = set()
    for (i, si, a), (j, sj, b) in itertools.permutations(rows, 2):
        out.add((i, j, round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 6)) if si == sj else None)
    out.discard(None)
    lists = {}
    for i, j, c in sorted(out, key=lambda r: (r[0], -r[2], r[1])):
        lists.setdefault(i, []).append((j, c))
    return {(i, j) for i, entries in lists.items() for j, c in entries[:k] if c >= least}


def vector_frame(spark, rows):
    return spark.createDataFrame([(i, s, None if v is None else [float(x) for x in v], "x", 1) for i, s, v in rows], "vec_id long, space string, vec array<float>, id string, cell int")


def test_neighbours_ties_copies_and_bad_vectors(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((6, 8))
    good = [(i, "w2v", (centres[i % 6] + 0.3 * rng.standard_normal(8)).astype(np.float32)) for i in range(60)]
    hot = rng.standard_normal(8).astype(np.float32)
    good += [(100 + i, "w2v", hot) for i in range(30)] + [(200 + i, "w2v", (hot * 2).astype(np.float32)) for i in range(3)]
    good += [(300 + i, "bert", rng.standard_normal(4).astype(np.float32)) for i in range(20)]
    bad = [(900, "w2v", None), (901, "w2v", [0.0] * 8), (902, "w2v", [float("nan")] + [1.0] * 7), (903, "w2v", [1.0] * 5), (904, None, [1.0] * 8), (905, "other", [1.0] * 8)]
    df = vector_frame(spark, [(i, s.upper() if i % 7 == 0 else s, v) for i, s, v in good] + bad)
    got = neighbours.neighbours(df, spark, spaces={"w2v": 8, "bert": 4})
    assert {(r.id, r.other) for r in got.collect()} == brute_lists(good)
    assert neighbours.neighbours(df.limit(0), spark).count() == 0


def test_tree_recall_and_blocks(spark, monkeypatch):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((150, 16))
    rows = [(i, "w2v", (centres[i % 150] + 0.4 * rng.standard_normal(16)).astype(np.float32)) for i in range(3000)]
    for name, value in (("LEAF", 40), ("CELL", 300), ("SAMPLE", 1500), ("BATCH", 500)):
        monkeypatch.setattr(neighbours, name, value)
    got = neighbours.neighbours(vector_frame(spark, rows), spark, spaces={"w2v": 16})
    found = {(r.id, r.other) for r in got.collect()}
    x = np.array([r[2] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1, kind="stable")[:, :5]
    want = {(i, int(j)) for i in range(3000) for j in best[i] if s[i, j] >= 0.75}
    assert len(found & want) >= 0.9 * len(want)
    tree = neighbours.Tree.fit(x.astype(np.float32)[:1500], 3000)
    tree.blocks[:] = 3  # a cell that was cut: the routed rows still meet in some block
    assert (np.sort(tree.visit(x[:50].astype(np.float32), int(tree.leaf.max()) + 1), axis=1) == np.arange(tree.leaf.max() + 1)).all()


# -- pieces --------------------------------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["word", "Ende. ", " ", "\n", "\r\n\r\n", "NAME: ", "x" * 37, "é", "ü̈", " "]), max_size=120), st.integers(20, 60), st.integers(0, 9))
def test_pieces_properties(parts, limit, overlap):
    text = "".join(parts)
    got = pieces.split_text(text, limit, overlap)
    if len(text) <= limit:
        assert got == []
        return
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b), (c, d) in zip(got, got[1:], strict=False):
        assert 0 < b - a <= limit and 0 < d - c <= limit and b < d
        assert 0 <= b - c <= overlap
        if b - c < overlap:  # fewer only to start at a word
            assert not text[c].isspace() and (c == 0 or text[c - 1].isspace())


def test_pieces_prefer_speeches(spark):
    text = "".join(f"HORATIO: {'Some words here. ' * 12}\n" for _ in range(40))
    for a, b in pieces.split_text(text)[:-1]:
        assert text[b:].startswith("HORATIO:")
    df = spark.createDataFrame([(1, None, 1), (2, "", 1), (3, "a" * 3000, 1), (4, "a" * 3001, 1), (4, "a" * 3001, 1), (5, text, 1)], "doc_id long, text string, piece_no int")
    rows = pieces.pieces(df).collect()
    assert {r.doc_id for r in rows} == {4, 5} and sum(r.doc_id == 4 and r.piece_no == 1 for r in rows) == 2
    for r in rows:
        if r.doc_id == 5:
            assert r.text == text[r.start_char : r.end_char]
    assert pieces.pieces(df.limit(0)).count() == 0


# -- pairs ---------------------------------------------------------------------------------------------------------


def exact_tail(k, q, m):
    d = np.array([1.0])
    for qs, ms in zip(q, m, strict=True):
        for _ in range(int(ms)):
            d = np.convolve(d, [1 - qs, qs])
    return d[int(k) :].sum()


def test_tail_against_convolution():
    rng = np.random.default_rng(2)
    for _ in range(60):
        m = rng.integers(1, 60, 4)
        q = rng.random(4) * rng.choice([0.05, 0.3, 0.9])
        k = max(0, int((m * q).sum()) + rng.integers(-4, 12))
        want, got = exact_tail(k, q, m), pairs.upper_tail(np.array([k]), q[None], m)[0]
        assert abs(got - want) <= 0.12 * want + 1e-12


def test_bicm_meets_degrees():
    degree, n_items = np.array([3, 10, 40, 100]), np.array([5, 4, 2, 1])
    size = np.array([1, 2, 4, 12])
    n_baskets = np.array([40, 30, 29, 1])
    n_baskets[0] += (degree * n_items).sum() - (size * n_baskets).sum()
    n_baskets[0] = max(n_baskets[0], 1)
    total = (size * n_baskets).sum()
    degree[2] += (total - (degree * n_items).sum()) // 2
    n_baskets[0] += (degree * n_items).sum() - (size * n_baskets).sum()
    x, y = pairs.fit_bicm(degree, n_items, size, n_baskets)
    p = pairs.probability(x[:, None], y)
    assert np.allclose((p * n_baskets).sum(1), degree, rtol=1e-4)
    assert np.allclose((p * n_items[:, None]).sum(0), size, rtol=1e-4)


def test_pair_counts_and_q_values(spark):
    rng = random.Random(3)
    rows = [(g, f"{g}{e}", rng.choice("abcdefgh")) for g in ("p", "q") for e in range(40) for _ in range(rng.randint(1, 5))]
    rows += rows[:50] + [(None, "x", "a"), ("p", None, "a"), ("p", "p1", None)] + [("all", f"e{i}", "z") for i in range(4)]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "play string, edge string, node string, c12 double")
    got = pairs.pair_surprise(df, "play", "edge", "node").collect()
    sets = {}
    for g, e, i in rows:
        if None not in (g, e, i):
            sets.setdefault((g, e), set()).add(i)
    want = {}
    for (g, _), s in sets.items():
        for a, b in itertools.combinations(sorted(s), 2):
            want[g, a, b] = want.get((g, a, b), 0) + 1
    assert {(r.g, r.a, r.b): r.c12 for r in got} == want
    for g in ("p", "q"):
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.p_value)
        k = len({i for (h, _), s in sets.items() if h == g for i in s})
        raw = [min(1.0, r.p_value * k * (k - 1) / 2 / (n + 1)) for n, r in enumerate(mine)]
        q = np.minimum.accumulate(raw[::-1])[::-1]
        assert np.allclose([r.q_value for r in mine], q)
    assert pairs.pair_surprise(df.limit(0), "play", "edge", "node").count() == 0


def test_big_basket(spark):
    df = spark.createDataFrame([("p", "e", str(i)) for i in range(800)], "g string, e string, i string")
    assert pairs.pair_counts(df, "g", "e", "i")[2].count() == 800 * 799 // 2


# -- tokens --------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(*tokens.load_vocabulary(VOCABULARY + ".tiktoken"))


def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY + ".json")
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab'sdtmrelvL  \n\t\r\x1c\x85\xa0　​.,!?-1½²٣éßñ中文😀́'’") | st.characters(exclude_categories=["Cs"]), max_size=60), max_size=6))
def test_ids_equal_the_library(encoder, texts):
    assert encoder.encode_column(pa.array(texts, pa.string())).to_pylist() == reference_ids(texts)


def test_long_texts_and_perfect_hash(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK", 64)
    texts = ["word, and 'll <|endoftext|>  more\n\n " * 200, "x" * 5000, " " * 900, "a b" * 300]
    assert encoder.encode_column(pa.array(texts)).to_pylist() == reference_ids(texts)
    p = encoder.perfect
    assert len(set(p.value.tolist())) == p.n and (p.value >= 0).all()


def test_empty_and_null_texts(spark):
    df = spark.createDataFrame([(1, None, [1]), (2, "", [1]), (3, "Hello", [1]), (3, "Hello", [1])], "doc_id long, text string, ids array<int>")
    rows = tokens.encode_corpus(df, spark).collect()
    assert sorted((r.doc_id, r.ids) for r in rows) == [(1, []), (2, []), (3, reference_ids(["Hello"])[0]), (3, reference_ids(["Hello"])[0])]
    assert tokens.encode_corpus(df.limit(0), spark).count() == 0


# -- leaks ----------------------------------------------------------------------------------------------------------


def plain_words(text):
    t = unicodedata.normalize("NFKD", text).lower()
    t = "".join(c for c in t if unicodedata.category(c) not in ("Mn", "Cf"))
    t = re.sub(r"(?<=[^\W_])[-‐][^\S\n\r]*(?:\r\n|\n|\r)[>\s]*(?=[^\W_])", "", t)
    return re.findall(r"[^\W_]+", t)


def test_words():
    texts = ["Él dijo: ﬁne ha-\r\n> > ppy end-\nless", "", "so­ft ze​ro \U0001d400bc - x-y\n-z", "trail-\n"]
    words, owner = leaks.words_of(texts)
    want = [plain_words(t) for t in texts]
    assert np.bincount(owner, minlength=4).tolist() == [len(w) for w in want]
    flat = [w for ws in want for w in ws]
    assert len(set(words.tolist())) == len(set(flat)) and len(words) == len(flat)


def test_leaks_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(30)] + ["a-\nb", "Ä", "x"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 6, 10, 25])))) for i in range(20)] + [(50, None), (51, ""), (52, "?!")]
    items.append((60, items[0][1]))
    docs = []
    for d in range(150):
        body = rng.choices(vocabulary, k=40)
        text = items[rng.randrange(20)][1].split()
        if d % 3 == 0:
            body[5:5] = text[: rng.randint(1, len(text))]
        docs.append((d, " ".join(body).upper() if d % 2 else "​" + " ".join(body)))
    docs += [(900, None), (901, ""), docs[0]]
    want = set()
    for (d, text), (i, item) in itertools.product(docs, items):
        w, v = plain_words(text or ""), plain_words(item or "")
        n = min(10, len(v))
        grams = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else set()
        if any(tuple(w[k : k + n]) in grams for k in range(len(w) - n + 1)):
            want.add((d, i))
    D = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, item_id string")
    I = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, doc_id int")
    assert {(r.doc_id, r.item_id) for r in leaks.leaked(D, I, spark).collect()} == want
    assert leaks.leaked(D, I.limit(0), spark).count() == 0 and leaks.leaked(D.limit(0), I, spark).count() == 0


def test_one_edit_recall():
    rng = np.random.default_rng(5)
    items = [" ".join(f"v{x}" for x in rng.integers(0, 4000, 12)) for _ in range(400)]
    index = leaks.Index(list(range(400)), items, 10, 1)
    texts = []
    for item in items:
        w = item.split()
        k = int(rng.integers(0, 12))
        w = w[:k] + [["other"], [], [w[k], "more"]][int(rng.integers(0, 3))] + w[k + 1 :]
        texts.append(" ".join(w))
    words, owner = leaks.words_of(texts)
    got = {(int(r[0]), int(r[1])) for r in index.matches(words, owner)}
    assert np.mean([(k, k) in got for k in range(400)]) >= 0.9


def test_edit_distances():
    def plain(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, d[0] = d[0], i
            for j, y in enumerate(b, 1):
                last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (x != y))
        return d[-1]

    rng = np.random.default_rng(6)
    a, b = rng.integers(0, 4, (50, 7)).astype(np.uint64), rng.integers(0, 4, (50, 7)).astype(np.uint64)
    near = np.where(rng.random((50, 7)) < 0.1, b, a)
    for x, y in ((a, near), (a, np.delete(a, 3, 1)), (np.insert(a, 2, 9, 1), a), (a, np.delete(b, 3, 1))):
        assert leaks.within_one(x, y).tolist() == np.minimum(leaks.edit_distances(x, y), 2).tolist()
    assert leaks.edit_distances(a, b).tolist() == [plain(x.tolist(), y.tolist()) for x, y in zip(a, b, strict=True)]


# -- severity ------------------------------------------------------------------------------------------------------


def spelled(text):
    codes, starts, ends = severity.plain([text])
    return ["".join(map(chr, codes[s:e])) for s, e in zip(starts, ends, strict=True)]


def test_plain_spelling():
    assert spelled("1mbéc1l3 sсum m.o.r.o.n and n a c k t rrrrat ra­t") == ["imbecile", "scum", "moron", "and", "nackt", "rat", "rat"]
    assert spelled("In 1520 a 3rd, wret#h!") [:3] == ["in", "1520", "a"]
    assert spelled("") == []


def test_severity_learns_and_scores(spark):
    rng = random.Random(7)
    calm = ["the lamp was green and old", "he sold a pig at the fair", "nobody knew the answer", "the rat ran along the beam"]
    bad = ["you stinking rat get out", "you worthless pig go and choke", "they are vermin every one of them"]
    docs, labels = [], []
    for i in range(400):
        s = rng.choices(calm, k=6)
        toxic = i % 4 == 0
        if toxic:
            s[rng.randrange(6)] = rng.choice(bad).replace("stinking", rng.choice(["stinking", "st1nking", "s t i n k i n g"]))
        docs.append((i, ". ".join(s), "src", 0.5))
        for reviewer in ("A", "b "):
            labels.append((i, reviewer, int(toxic) if rng.random() > 0.05 else 1 - int(toxic), None))
    docs += [(1000, None, None, 0.5), (1001, "", "src", 0.5), (1002, " \n ", "src", 0.5)]
    labels += [labels[0], (None, "A", 1, None), (3, None, None, None), (99999, "A", 1, None)]
    D = spark.createDataFrame(docs, "doc_id long, text string, source string, severity double")
    L = spark.createDataFrame(labels, "doc_id long, reviewer string, toxic int, labelled_at timestamp")
    T = spark.createDataFrame([("rat", "abuse"), (None, "hate"), ("vermin", "hate")], "term string, kind string")
    out = {r.doc_id: r.severity for r in severity.score(D, severity.fit_model(D, L, T), spark).collect()}
    assert all(out[i] == 0 for i in (1000, 1001, 1002))
    right = np.mean([(out[i] >= severity.CASE) == (i % 4 == 0) for i in range(400)])
    assert right >= 0.97
    alone = severity.score(D, severity.fit_model(D, L.limit(0), T), spark)  # the terms alone decide
    named = {i for i, t, _, _ in docs if t and re.search(r"\b(rat|vermin)\b", t)}
    assert {r.doc_id for r in alone.filter(F.col("severity") >= severity.CASE).collect()} == named
    assert severity.score(D.limit(0), severity.fit_model(D.limit(0), L, T), spark).count() == 0


# -- queries ---------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, small, name):
    df = queries.QUERIES[name](spark, small)
    assert df.count() >= 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_against_sql(spark, small, name):
    import glob
    import os

    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, small)
    want = {tuple(r) for r in con.execute(f"SELECT {', '.join(df.columns)} FROM ({queries.SQL[name]})").fetchall()}
    assert {tuple(r) for r in df.collect()} == want
