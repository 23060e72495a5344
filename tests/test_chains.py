"""The chains of a book and a corpus, embeddings by span and batch, files."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from castgraph import sources
from castgraph.operators import compare, contexts, embed, entities, play
from castgraph.plans.facades import Book, Corpus
from castgraph.sources import sinks

TEXT = "Hamlet met Horatio near the castle. Hamlet left; Horatio stayed with the king. The king praised Hamlet, and Horatio laughed at the king. " * 6


@pytest.fixture(scope="module")
def book(spark):
    texts = spark.createDataFrame([("ham", TEXT), ("empty", ""), ("none", None)], "book string, text string")
    return Book(texts, entities.alias_rows(spark, ["hamlet prince", "horatio friend", "king claudius", "ghost"]))


def test_contexts_in_the_row_equal_the_joined_ones(spark, book):
    books = book.books.filter("tokens IS NOT NULL")
    names = book.aliases.filter("alias_idx = 0")
    named = entities.mentions(book.tokens, names)
    want = contexts.context_texts(contexts.entity_contexts(named, books.select("book", F.size("tokens").alias("n_tokens")), 4), books)
    assert {tuple(r) for r in book.contexts(4).collect()} == {tuple(r) for r in want.collect()} != set()


def test_word_pairs_fall(book):
    rows = book.word_similarities(epochs=2).collect()
    assert [(min(r.char1, r.char2), max(r.char1, r.char2)) for r in sorted(rows, key=lambda r: (r.char1, r.char2))] == [("hamlet", "horatio"), ("hamlet", "king"), ("horatio", "king")]
    assert [r.value for r in rows] == sorted((r.value for r in rows), reverse=True)
    assert [tuple(r) for r in rows] == [tuple(r) for r in book.word_similarities(epochs=2).collect()]


def test_cbow_brings_shared_contexts_together():
    rng = np.random.default_rng(0)
    tokens = []
    for _ in range(900):
        kind = rng.integers(0, 2)
        tokens += [f"{'ab'[kind]}{rng.integers(0, 4)}" for _ in range(6)]
    words, x = embed.train_cbow(tokens, 8, 3, epochs=20)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    of = np.array([w[0] == "a" for w in words])
    assert s[of][:, of].mean() > s[of][:, ~of].mean() + 0.3


def _kinds(n):
    rng = np.random.default_rng(1)
    return [[f"{'ab'[kind]}{i}" for kind in rng.integers(0, 2, 12) for i in rng.integers(0, 4, 6)] for _ in range(n)]


def _apart(rows):
    x = np.array([r.vec for r in rows])
    s = (x := x / np.linalg.norm(x, axis=1, keepdims=True)) @ x.T
    of = np.array([r.word[0] == "a" for r in rows])
    return s[of][:, of].mean() - s[of][:, ~of].mean()


def test_word_vectors_of_a_corpus_in_time(spark, monkeypatch):
    """720,000 tokens; every word has a vector, null tokens and single words do no harm."""
    monkeypatch.setattr(embed, "LEAST_PART", 100_000)
    books = spark.createDataFrame([(t,) for t in [*_kinds(10_000), ["alone"], [], [None, "a0", None, "a1"], None]], "tokens array<string>").repartition(4)
    began = time.time()
    rows = embed.word2vec_of(books, window=3, partitions=4).collect()
    assert time.time() - began < 45
    assert sorted(r.word for r in rows) == sorted([f"{k}{i}" for k in "ab" for i in range(4)] + ["alone"]) and all(len(r.vec) == 7 for r in rows)
    assert _apart([r for r in rows if r.word != "alone"]) > 0.3


def test_changes_added_by_the_executors_and_token_tables(spark, monkeypatch):
    rows = [(b, i, t) for b, ts in enumerate(_kinds(300)) for i, t in enumerate(ts)]
    tokens = spark.createDataFrame(rows, "book int, pos int, token string")
    here = {r.word: r.vec for r in embed.word2vec(tokens, window=3, partitions=2).collect()}
    monkeypatch.setattr(embed, "LEAST_PART", 5_000)
    monkeypatch.setattr(embed, "HELD", 0)
    monkeypatch.setattr(embed, "CHUNK", 3)
    there = embed.word2vec(tokens, window=3, partitions=2).collect()
    assert {r.word for r in there} == set(here) and _apart(there) > 0.3
    assert embed.word2vec(tokens.filter("book < 0")).count() == 0


def test_a_step_follows_the_gradient():
    """Windowed sums by running sums give the same step as sums position by position."""
    rng = np.random.default_rng(2)
    ids, at = np.array([2, 5, 7]), np.array([0, 1, 2, 0, 1, -1, -1, 2, 0, -1, -1])
    noise, reach = np.array([5, 9, 9, 0]), 2
    model = [rng.standard_normal((10, 4)).astype(np.float32) for _ in range(2)] + [np.full((10, 4), 1e9, np.float32) for _ in range(2)]
    into, out = (x.astype(float) for x in model[:2])
    want = [np.zeros((10, 4)), np.zeros((10, 4))]
    for i in np.flatnonzero(at >= 0):
        near = [j for j in range(max(0, i - reach), min(len(at), i + reach + 1)) if j != i and at[j] >= 0]
        h, own = into[ids[at[near]]].mean(0), ids[at[i]]
        pull = [(own, 1 - 1 / (1 + np.exp(-h @ out[own])))] + [(w, -10 / 4 / (1 + np.exp(-h @ out[w]))) for w in noise if w != own]
        for w, g in pull:
            want[1][w] += g * h
            for j in near:
                want[0][ids[at[j]]] += g * out[w]
    before = [x.copy() for x in model[:2]]
    embed.cbow_block(model, ids, at, reach, noise, 1e3)
    for x, y, z in zip(before, model[:2], want, strict=True):
        assert np.allclose((y - x) / 1e3 * np.sqrt(1e9), z, atol=2e-2)


def test_ten_columns_of_a_book(spark, book, tmp_path):
    rows = book.compared("ham", k=2)
    got = rows.collect()
    assert len(got) == 3 and len(rows.columns) == 10 and [r.cooc for r in got] == sorted(r.cooc for r in got)
    top = max(got, key=lambda r: r.cooc)
    assert top.cooc_cluster == max(r.cooc_cluster for r in got) and all(-1.000001 <= x <= 1.000001 for r in got for x in (r.w2v, r.bert_entity, r.bert_cls))
    back = spark.read.csv(sinks.write_clustered(rows, str(tmp_path / "c")), sep="\t", header=True)
    assert tuple(back.columns) == sinks.CLUSTERED and back.count() == 3


def test_corpus_table(spark, tmp_path):
    texts = spark.createDataFrame([("a", TEXT), ("b", TEXT.replace("Horatio", "Ophelia"))], "book string, text string")
    aliases = entities.alias_rows(spark, ["hamlet", "horatio", "king"]).withColumn("book", F.lit("a")).unionByName(entities.alias_rows(spark, ["hamlet", "ophelia"]).withColumn("book", F.lit("b")))
    df = Corpus(texts, aliases).compared_pairs()
    rows = {(r.char1, r.char2): r for r in df.collect()}
    assert set(rows) == {(x, y) for x in ("hamlet", "horatio", "king", "ophelia") for y in ("hamlet", "horatio", "king", "ophelia") if x < y}
    assert rows["horatio", "ophelia"].same_book == 0 and rows["hamlet", "ophelia"].same_book == 1 and rows["hamlet", "king"].char_book == "b"
    back = spark.read.csv(sinks.write_corpus(df, str(tmp_path / "p")), header=True)
    assert tuple(back.columns) == sinks.CORPUS and [r.Char1 for r in back.collect()] == sorted(k[0] for k in rows)


def test_span_first_piece_and_batches(spark):
    df = spark.createDataFrame([("the old Prospero sleeps", "prospero"), ("nobody here", "ariel"), ("", "ariel"), (None, "ariel")], "text string, entity string")
    got = embed.embed_entities(df).collect()
    model = embed.ContextHashingEmbedder()
    rows = model.rows(["the", "old", "prospero", "sleeps"])
    assert np.allclose(got[0].ent_vec, rows[2]) and np.allclose(got[0].cls_vec, rows[0])
    assert np.allclose(got[1].ent_vec, got[1].cls_vec) and set(got[2].ent_vec) == {0.0} == set(got[3].cls_vec)
    plain = embed.HashingEmbedder()
    long = " ".join(f"w{i}" for i in range(40))
    texts = spark.createDataFrame([("a b",), (long,), (None,), ("",)], "t string")
    batched = [r.vec for r in embed.embed_batched(texts, "t", batch_size=3, most=12).collect()]
    assert np.allclose(batched[0], plain.rows([embed.FIRST, "a", "b", embed.LAST]).mean(0), atol=1e-5)
    assert np.allclose(batched[1], plain.rows([embed.FIRST, *long.split()[:10], embed.LAST]).mean(0), atol=1e-5)
    assert batched[2] is None and np.allclose(batched[3], plain.rows([embed.FIRST, embed.LAST]).mean(0), atol=1e-5)
    every = embed.embed(texts, "t", pooling="all").first().vec
    assert np.allclose(every, plain.rows(["a", "b"]))
    assert np.allclose(embed.masked_mean(np.arange(12.0).reshape(2, 3, 2), np.array([[1, 1, 0], [0, 0, 0]])), [[1, 2], [0, 0]])


def test_nested_elements_of_one_name(spark):
    xml = '﻿<?xml version="1.0"?><a xmlns:t="u"><t:seg n=">">one<seg/>é<seg x="/"></seg></t:seg><!--<seg>no</seg>--><![CDATA[<seg>]]><segment/></a>'
    df = spark.createDataFrame([(1, xml), (2, '{"payload": "<a><seg>two</seg></a>"}'), (3, "<a><seg>"), (4, None), (5, "[1]")], "record_id long, body string")
    got = [tuple(r) for r in play.tags(df, "record_id", "body", "seg").orderBy("play", "idx").collect()]
    assert got == [(1, 0, '<t:seg n=">">one<seg/>é<seg x="/"></seg></t:seg>'), (1, 1, "<seg/>"), (1, 2, '<seg x="/"></seg>'), (2, 0, "<seg>two</seg>")]


def test_repeated_edges(spark):
    rows = spark.createDataFrame([("a", "b", 2.0, 1), ("b", "a", 4.0, 2), ("a", "b", 1.0, 3), ("c", "d", 5.0, 1)], "char1 string, char2 string, value double, seq int")
    assert {tuple(r) for r in compare.graph(rows, "w2v", "seq")[1].collect()} == {("a", "b", 1.0), ("c", "d", 5.0)}
    assert {tuple(r) for r in compare.graph(rows, "w2v")[1].collect()} == {("b", "a", 4.0), ("c", "d", 5.0)}


def test_vector_files(spark, tmp_path):
    vecs = spark.createDataFrame([(f"w{i}", [float(i), 0.5]) for i in range(7)], "word string, vec array<double>")
    want = {(r.word, tuple(r.vec)) for r in vecs.collect()}
    for words in (100, 2):
        back = sources.vector_json(spark, sinks.write_vectors_json(vecs, str(tmp_path / f"j{words}"), words))
        assert {(r.word, tuple(r.vec)) for r in back.collect()} == want
    path = sinks.write_vectors_text(vecs, str(tmp_path / "t"), header=True)
    assert spark.read.text(path).first().value == "7 2"
    assert {(r.word, tuple(r.vec)) for r in sources.vector_lines(spark, path).collect()} == want
    with pytest.warns(UserWarning):
        assert sources.flat_names(spark, str(tmp_path / "missing")).count() == 0
