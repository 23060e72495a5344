"""Embeddings of texts: O-67, O-79..O-84. The embedder is pluggable; the defaults need no model file.

An Embedder turns a list of word pieces into one vector each; pooling is ``mean``, ``cls`` (the first piece) or ``all`` (a vector per piece).  It is
built once per Python worker and called on Arrow batches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.functions import checkpointed, mapped
from castgraph.functions.shipping import ship_package

POOLING = ("mean", "cls", "all")
FIRST, LAST = "[CLS]", "[SEP]"
BLOCK, LEAST_BLOCK, STEPS = 8192, 128, 512  # word vectors: positions of a step, fewer where a partition would have less than STEPS of them in an iteration
LEAST_PART = 1 << 19  # tokens; models of fewer have too few steps for the changes of several to add up well
SHARED, CHUNK, HELD = 64, 1 << 14, 64 << 20  # noise words of a step; words of a row of changes; bytes of changes that the driver adds up, the executors beyond


class Embedder(Protocol):
    dim: int

    def pieces(self, text: str) -> list[str]:
        """The word pieces of a text, without special ones."""

    def rows(self, pieces: list[str]) -> np.ndarray:
        """One row per piece."""


class HashingEmbedder:
    """Deterministic vectors by feature hashing of words: each word has a fixed direction."""

    def __init__(self, dim: int = 64):
        self.dim = dim
        self._seen: dict[str, np.ndarray] = {}

    def pieces(self, text: str) -> list[str]:
        return text.lower().split()

    def rows(self, pieces: list[str]) -> np.ndarray:
        return np.array([self._word(w) for w in pieces], np.float32).reshape(-1, self.dim)

    def tokens(self, text: str) -> np.ndarray:
        return self.rows(self.pieces(text))

    def _word(self, word: str) -> np.ndarray:
        if word not in self._seen:
            if len(self._seen) > 100_000:
                self._seen.clear()
            seed = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "little")
            self._seen[word] = np.random.default_rng(seed).standard_normal(self.dim).astype(np.float32)
        return self._seen[word]


class ContextHashingEmbedder(HashingEmbedder):
    """A word's direction plus half the mean of those within two places, so a word's vector depends on its neighbours."""

    def rows(self, pieces: list[str]) -> np.ndarray:
        own = super().rows(pieces)
        total, count = np.zeros_like(own), np.zeros((len(own), 1), np.float32)
        for d in (1, 2):
            total[d:] += own[:-d]
            total[:-d] += own[d:]
            count[d:] += 1
            count[:-d] += 1
        return own + 0.5 * total / np.maximum(count, 1)


def pool(rows: np.ndarray, pooling: str, dim: int) -> np.ndarray:
    if pooling not in POOLING:
        raise ValueError(f"unknown pooling: {pooling}")
    if pooling == "all":
        return rows
    if not len(rows):
        return np.zeros(dim, np.float32)
    return rows[0] if pooling == "cls" else rows.mean(0)


def masked_mean(rows: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """texts x places x dim and texts x places: each text's mean over the places of its mask."""
    return (rows * mask[:, :, None]).sum(1) / np.maximum(mask.sum(1, keepdims=True), 1e-9)


_MODELS: dict[str, Embedder] = {}


def _model(make: Callable[[], Embedder], name: str) -> Embedder:
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


def _as_column(df: DataFrame, columns: list[str], out: str, each: Callable, kind: str) -> DataFrame:
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield each(batch)

    run.__annotations__ = {"batches": Iterator[pd.DataFrame], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, kind)(F.struct(*columns)))


def embed(df: DataFrame, text: str, out: str = "vec", make: Callable[[], Embedder] = HashingEmbedder, name: str = "hashing", pooling: str = "mean") -> DataFrame:
    """Adds the pooled vector of each text, whole and without special pieces; null texts have none. ``all`` gives an array of vectors."""
    if pooling not in POOLING:
        raise ValueError(f"unknown pooling: {pooling}")

    def each(batch: pd.DataFrame) -> pd.Series:
        model = _model(make, name)
        vectors = (None if t is None else pool(model.rows(model.pieces(t)), pooling, model.dim) for t in batch[text])
        return pd.Series([list(v) if pooling == "all" and v is not None else v for v in vectors], dtype=object)

    return _as_column(df, [text], out, each, "array<array<float>>" if pooling == "all" else "array<float>")


def embed_batched(df: DataFrame, text: str, out: str = "vec", make: Callable[[], Embedder] = HashingEmbedder, name: str = "hashing", batch_size: int = 32, most: int = 512) -> DataFrame:
    """Adds the mean over a text's pieces and the special ones around them, cut to ``most`` pieces in all; ``batch_size`` texts are padded to one length and embedded together."""

    def each(batch: pd.DataFrame) -> pd.Series:
        model, out = _model(make, name), []
        texts = batch[text].tolist()
        for k in range(0, len(texts), batch_size):
            pieces = [[FIRST, *model.pieces(t or "")[: most - 2], LAST] for t in texts[k : k + batch_size]]
            width = max(map(len, pieces))
            rows, mask = np.zeros((len(pieces), width, model.dim), np.float32), np.zeros((len(pieces), width), np.float32)
            for i, p in enumerate(pieces):
                rows[i, : len(p)], mask[i, : len(p)] = model.rows(p), 1
            out += list(masked_mean(rows, mask))
        return pd.Series([None if t is None else v for t, v in zip(texts, out, strict=True)], dtype=object)

    return _as_column(df, [text], out, each, "array<float>")


def span_of(pieces: list[str], wanted: list[str]) -> int:
    """Where the wanted pieces first occur in a row; lower case is tried next; else 0."""
    n = len(wanted)
    for have, want in ((pieces, wanted), ([p.lower() for p in pieces], [w.lower() for w in wanted])):
        for i in range(len(have) - n + 1 if n else 0):
            if have[i : i + n] == want:
                return i
    return 0


def embed_entities(contexts: DataFrame, text: str = "text", entity: str = "entity", make: Callable[[], Embedder] = ContextHashingEmbedder, name: str = "context hashing") -> DataFrame:
    """Adds ent_vec, the mean of the entity's pieces in its context, and cls_vec, the context's first piece; empty contexts have zeros."""
    schema = contexts.select("*", F.lit(None).cast("array<float>").alias("ent_vec"), F.lit(None).cast("array<float>").alias("cls_vec")).schema
    names = contexts.columns

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        model = _model(make, name)
        for batch in batches:
            found, firsts = [], []
            for t, e in zip(batch.column(names.index(text)).to_pylist(), batch.column(names.index(entity)).to_pylist(), strict=True):
                pieces, wanted = model.pieces(t or ""), model.pieces(e or "")
                at = span_of(pieces, wanted)
                rows = model.rows(pieces)
                found.append(pool(rows[at : at + max(1, len(wanted))], "mean", model.dim))
                firsts.append(pool(rows, "cls", model.dim))
            column = lambda v: pa.array(v, pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, column(found), column(firsts)], names=[*names, "ent_vec", "cls_vec"])

    return mapped(contexts, run, schema)


def _moved(vectors: np.ndarray, rows: np.ndarray, steps: np.ndarray) -> None:
    """Adds each row's steps, together as long as their number's root times their mean, so frequent words don't run away."""
    which, at, n = np.unique(rows, return_inverse=True, return_counts=True)
    total = np.stack([np.bincount(at, steps[:, d], len(which)) for d in range(vectors.shape[1])], 1)
    vectors[which] += total / np.sqrt(n)[:, None]


def train_cbow(tokens: list[str], dim: int, window: int, seed: int = 42, epochs: int = 10, negative: int = 10, rate: float = 0.05, batch: int = 128) -> tuple[list[str], np.ndarray]:
    """The words of a text and their vectors: continuous bag of words with negative samples, in small batches."""
    words, ids = np.unique(np.array(tokens, dtype=object), return_inverse=True)
    rng = np.random.default_rng(seed)
    into, out = (rng.random((len(words), dim)) - 0.5) / dim, np.zeros((len(words), dim))
    share = np.bincount(ids) ** 0.75
    share = np.cumsum(share / share.sum())
    n = len(ids)
    steps = [d for d in range(-window, window + 1) if d]
    for epoch in range(epochs):
        step_rate = rate * (1 - epoch / epochs)
        reach = rng.integers(1, window + 1, n)
        for part in np.array_split(rng.permutation(n), -(-n // batch)):
            place = part[:, None] + steps
            near = (place >= 0) & (place < n) & (np.abs(steps) <= reach[part][:, None])
            around = ids[np.clip(place, 0, n - 1)]
            count = np.maximum(near.sum(1, keepdims=True), 1)
            hidden = (into[around] * near[:, :, None]).sum(1) / count
            chosen = np.concatenate([ids[part][:, None], np.minimum(np.searchsorted(share, rng.random((len(part), negative))), len(words) - 1)], 1)
            miss = -1 / (1 + np.exp(-np.clip(np.einsum("bd,bkd->bk", hidden, out[chosen]), -30, 30)))
            miss[:, 0] += 1
            miss[:, 1:][chosen[:, 1:] == chosen[:, :1]] = 0
            back = np.einsum("bk,bkd->bd", miss, out[chosen]) * step_rate
            _moved(out, chosen.ravel(), (step_rate * miss[:, :, None] * hidden[:, None]).reshape(-1, dim))
            _moved(into, around[near], np.repeat(back / count, near.sum(1), axis=0))
    return words.tolist(), into


def word2vec_by_book(books: DataFrame, dim: int = 7, window: int = 15, seed: int = 42, epochs: int = 10) -> DataFrame:
    """(book, word, vec): a model of its own for each row of (book, tokens array); books without tokens have none."""
    schema = books.select("book", F.lit("").alias("word"), F.lit(None).cast("array<double>").alias("vec")).schema

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                tokens = batch.column(1)[k].as_py()
                if tokens:
                    words, vectors = train_cbow(tokens, dim, window, seed, epochs)
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(words), batch.schema.field(0).type), pa.array(words, pa.string()), pa.array(list(vectors), pa.list_(pa.float64()))], names=["book", "word", "vec"])

    return mapped(books.select("book", "tokens"), run, schema)


def _blocks(batches: Iterator, words: np.ndarray, sentence: int, window: int, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Sentences of token arrays in blocks of about ``size`` positions: a block's word numbers, and the place of each position among them; ``window`` empty places (-1) follow each sentence."""
    import pyarrow as pa
    import pyarrow.compute as pc

    known, block, held = pa.array(words, pa.string()), [], 0
    for batch in batches:
        ids = pc.index_in(batch.column(0).flatten(), known).fill_null(-1).to_numpy(zero_copy_only=False)
        ends = np.cumsum(batch.column(0).value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        for row in np.split(ids, ends[:-1]):
            row = row[row >= 0]  # null tokens
            for k in range(0, len(row), sentence):
                part = row[k : k + sentence]
                if len(part) > 1:  # a single word has no context
                    block += [part, np.full(window, -1, np.int32)]
                    held += len(part) + window
                if held >= size:
                    yield _numbered(block)
                    block, held = [], 0
    if block:
        yield _numbered(block)


def _numbered(block: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    ids, at = np.unique(np.concatenate(block), return_inverse=True)
    return ids[1:], at - 1  # the empty places are the smallest


def _stepped(x: np.ndarray, squares: np.ndarray, rows: np.ndarray, steps: np.ndarray, rate: float) -> None:
    """Adaptive steps: each number by its sum of squared gradients, so neither frequent nor rare words run away."""
    squares[rows] += steps * steps
    x[rows] += rate * steps / np.sqrt(squares[rows])


def cbow_block(model: list[np.ndarray], ids: np.ndarray, at: np.ndarray, reach: int, noise: np.ndarray, rate: float, negative: int = 10) -> None:
    """One step of continuous bag of words over all positions of a block. model: input and output vectors and their squared gradients. noise: the block's drawn words; each
    counts negative / len(noise) times at every position. All sums over windows are differences of running sums."""
    into, out, into_squares, out_squares = model
    n, u, dim = len(at), len(ids), into.shape[1]
    order = np.argsort(at, kind="stable")
    first = np.searchsorted(at[order], np.arange(u))  # every word occurs
    at = at.astype(np.intp)
    word = (at >= 0).astype(np.float32)

    def around(x: np.ndarray) -> np.ndarray:
        total = np.zeros((len(x), n + 2 * reach + 1), np.float32)
        np.cumsum(x, axis=1, out=total[:, reach + 1 : n + reach + 1])
        total[:, n + reach + 1 :] = total[:, n + reach, None]
        total = total[:, 2 * reach + 1 :] - total[:, :n]
        total -= x
        return total

    def by_word(x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x.take(order, axis=1), first, axis=1).T

    own, target = np.zeros((2, dim, u + 1), np.float32)  # the last is the empty place
    own[:, :u], target[:, :u] = into[ids].T, out[ids].T
    own, target = own.take(at, axis=1, mode="wrap"), target.take(at, axis=1, mode="wrap")
    count = around(word[None])[0] * word
    live = (count > 0).astype(np.float32)
    hidden = around(own)
    hidden *= live / np.maximum(count, 1)  # 0 where nothing is learned
    noise, times = np.unique(noise, return_counts=True)
    others = out[noise]
    with np.errstate(over="ignore"):
        miss = 1 / (1 + np.exp(np.einsum("dn,dn->n", hidden, target)))
        wrong = -others @ hidden
        np.exp(wrong, out=wrong)
    wrong += 1
    np.divide((times * (-negative / times.sum())).astype(np.float32)[:, None], wrong, out=wrong)
    of = np.full(u + 1, -1)  # a position's own word is no noise to it
    _, mine, drawn = np.intersect1d(ids, noise, assume_unique=True, return_indices=True)
    of[mine] = drawn
    of = of.take(at, mode="wrap")
    same = np.flatnonzero(of >= 0)
    wrong[of[same], same] = 0
    target *= miss
    target += others.T @ wrong
    target *= live
    hit = by_word(miss * hidden)
    _stepped(into, into_squares, ids, by_word(around(target)), rate)
    steps = wrong @ hidden.T
    steps[drawn] += hit[mine]
    rest = np.ones(u, bool)
    rest[mine] = False
    _stepped(out, out_squares, ids[rest], hit[rest], rate)
    _stepped(out, out_squares, noise, steps, rate)


def word2vec_of(books: DataFrame, column: str = "tokens", dim: int = 7, window: int = 15, seed: int = 42, sentence: int = 1000, partitions: int = 1, iterations: int = 10, negative: int = 10, rate: float = 0.2) -> DataFrame:
    """(word, vec) of a corpus of token arrays, in sentences of ``sentence`` tokens: continuous bag of words with negative samples.

    Every token of every sentence is a target in every iteration. A block of about BLOCK positions makes one step: its reach is drawn from 1 to ``window``, its SHARED noise words by
    their frequency to the power of 0.75. ``partitions`` models (fewer for less than LEAST_PART tokens each) are trained side by side in an iteration, then a word's changes are added up and divided by the root of
    how many models met it, as its adaptive steps would be for so many more examples, and its squared gradients are added up.
    Words are counted first; sentences are then kept as word numbers in the checkpoint folder.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    spark = books.sparkSession
    rows = books.select(F.col(column).alias("words"))
    counts = rows.select(F.explode("words").alias("word")).filter("word IS NOT NULL").groupBy("word").count().orderBy("word").toArrow()
    words, share = counts.column("word").to_numpy(), np.cumsum(counts.column("count").to_numpy() ** 0.75)
    if not len(words):
        return spark.createDataFrame([], "word string, vec array<double>")
    known = spark.sparkContext.broadcast((words, share / share[-1]))
    tokens = sum(counts.column("count").to_pylist())
    partitions = max(1, min(partitions, tokens // LEAST_PART))
    size = int(min(BLOCK, max(LEAST_BLOCK, tokens // (STEPS * partitions))))
    kind = pa.int16() if BLOCK + sentence + window < 1 << 15 else pa.int32()
    wide = 4 * dim

    def numbered(batches: Iterator) -> Iterator:
        for ids, at in _blocks(batches, known.value[0], sentence, window, size):
            yield pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int32())), pa.array([at], pa.list_(kind))], names=["ids", "at"])

    blocks = checkpointed(mapped(rows, numbered, f"ids array<int>, at array<{'smallint' if kind == pa.int16() else 'int'}>").repartition(partitions))
    start = (np.random.default_rng(seed).random((len(words), dim)) - 0.5) / dim
    model = [start.astype(np.float32), np.zeros_like(start, np.float32), *(np.full_like(start, 0.01, np.float32) for _ in range(2))]

    def trained(shared: object, iteration: int) -> Callable:
        def run(batches: Iterator) -> Iterator:
            part = TaskContext.get().partitionId()
            rng, now = np.random.default_rng([seed, iteration, part]), [x.copy() for x in shared.value]
            met = np.zeros(len(now[0]), bool)
            for batch in batches:
                for k in range(batch.num_rows):
                    ids, at = (batch.column(c)[k].values.to_numpy() for c in (0, 1))
                    noise = np.minimum(np.searchsorted(known.value[1], rng.random(SHARED)), len(met) - 1)
                    cbow_block(now, ids, at, int(rng.integers(1, window + 1)), noise, rate * (1 - iteration / iterations), negative)
                    met[ids] = met[noise] = True
            for lo in range(0, len(met), CHUNK):
                mine = lo + np.flatnonzero(met[lo : lo + CHUNK])
                if len(mine):
                    values = np.concatenate([x[mine] - y[mine] for x, y in zip(now, shared.value, strict=True)], 1)
                    yield pa.RecordBatch.from_arrays([pa.array([lo // CHUNK], pa.int32()), pa.array([part], pa.int32()), pa.array([mine], pa.list_(pa.int32())), pa.array([values.ravel()], pa.list_(pa.float32()))], names=["chunk", "part", "ids", "vecs"])

        return run

    def averaged(table: pa.Table) -> pa.Table:
        lo = table.column("chunk")[0].as_py() * CHUNK
        total, n = np.zeros((CHUNK, wide)), np.zeros(CHUNK)
        for k in np.argsort(table.column("part").to_numpy()):
            at = table.column("ids")[k].values.to_numpy() - lo
            total[at] += table.column("vecs")[k].values.to_numpy().reshape(-1, wide)
            n[at] += 1
        at = np.flatnonzero(n)
        total[:, : 2 * dim] /= np.sqrt(np.maximum(n, 1))[:, None]
        return pa.table({"ids": pa.array([lo + at], pa.list_(pa.int32())), "vecs": pa.array([total[at].astype(np.float32).ravel()], pa.list_(pa.float32()))})

    for iteration in range(iterations):
        shared = spark.sparkContext.broadcast(model)
        parts = mapped(blocks, trained(shared, iteration), "chunk int, part int, ids array<int>, vecs array<float>")
        if partitions * len(words) * wide * 4 <= HELD:  # no shuffle
            table = parts.toArrow()
            merged = pa.concat_tables([averaged(table.filter(pc.equal(table.column("chunk"), c))) for c in table.column("chunk").unique()]) if len(table) else table
        else:
            merged = parts.groupBy("chunk").applyInArrow(averaged, "ids array<int>, vecs array<float>").toArrow()
        for k in range(len(merged)):
            at, values = merged.column("ids")[k].values.to_numpy(), merged.column("vecs")[k].values.to_numpy().reshape(-1, wide)
            for i, x in enumerate(model):
                x[at] += values[:, i * dim : (i + 1) * dim]
        shared.destroy()
    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(words) * dim + 1, dim, dtype=np.int32)), pa.array(model[0].astype(np.float64).ravel()))
    return spark.createDataFrame(pa.table({"word": pa.array(words, pa.string()), "vec": vectors}), "word string, vec array<double>")


def word2vec(tokens: DataFrame, dim: int = 7, window: int = 15, seed: int = 42, sentence: int = 1000, partitions: int = 1, iterations: int = 10) -> DataFrame:
    """(word, vec) of a token table (book, pos, token): a book's tokens in sentences of ``sentence`` positions."""
    part = (F.col("pos") / sentence).cast("bigint")
    sentences = tokens.groupBy("book", part.alias("part")).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]).alias("tokens"))
    return word2vec_of(sentences, "tokens", dim, window, seed, sentence, partitions, iterations)
