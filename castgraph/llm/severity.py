"""Severity of abusive, hateful or sexual content, by cumulative-link ordinal regression on sparse text features.

Text.  Spellings are made plain first: compatibility form without marks and invisible characters, look-alike letters and digits or signs
inside words read as the letters they stand for, letters repeated three times or more read once, words spelled out
letter by letter joined.  Features are hashed one-, two- and three-word sequences and pairs around a word within a sentence
(2**FEATURE_BITS buckets), a listed term counting also as its kind.  A document's score is that of its worst sentence, so length doesn't matter.

Model.  Reviewers' votes give ordered grades: 0 none, 1 disputed, 2 agreed.  P(grade > g) = logistic(w.x - threshold_g): one weight
vector for all thresholds.  The worst sentence of a document changes with w, so it is chosen anew in each step of the fit.
Output is the expected severity, the sum of both probabilities, between 0 and 2; a document is a case from CASE on.

Scale.  The fit takes a bounded sample of labelled documents (MAX_LABELLED, those with the smallest hash of their id).  Their features are made and
counted on the executors; the driver gets numbers only, a list per sentence of those that occur in LEAST_DOCS documents and more.  Scoring is
a single pass without shuffle over all documents and whole texts; the weights (4 MB at 20 bits) are broadcast.

Defined results: null, empty and blank texts score 0 and are no cases; repeated votes of one reviewer on a document count
once (the latest); null votes don't count; without any labels of both kinds, the listed terms alone decide; repeated ids are
each scored; other columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castgraph.functions import checkpointed, mapped
from castgraph.llm.wordhash import mix, substring_hashes, word_classes

FEATURE_BITS, MAX_LABELLED, STEPS, RATE, RIDGE = 20, 12_000, 160, 0.08, 6e-4
LEAST_DOCS = 2
CASE = 0.7
CHUNK = 1 << 18
#: Letters of other alphabets and signs read as Latin letters. Fixed values.
LOOKALIKES = dict(zip("авеёзіјкмнорстухѕԁɡιοαενρτυχκ", "abeezijkmhopctyxsdgioaevptuxk", strict=True))
SIGNS = dict(zip("0134578@$!|€+", "oleastbasiiet", strict=True)) | {"1": "i"}
MASKS = "*#@%_$"
ENDS = ".!?…。！？;"
MASK = 0xE000  # a private character for a hidden letter


def _table(pairs: dict[str, str]) -> np.ndarray:
    out = np.arange(0x110000, dtype=np.uint32)
    for a, b in pairs.items():
        out[ord(a)] = ord(b)
    return out


_TABLES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    if not _TABLES:
        classes = word_classes()
        letter = np.array([chr(i).isalpha() for i in range(0x110000)], bool) & (classes == 1)
        letter[MASK] = True
        _TABLES.update(drop=classes == 2, word=classes == 1, letter=letter, alike=_table(LOOKALIKES), sign=_table(SIGNS))
        _TABLES["signs"] = np.zeros(0x110000, bool)
        _TABLES["signs"][[ord(c) for c in {*SIGNS, *MASKS}]] = True
    return _TABLES


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The code points of all texts in plain spelling, texts apart by zeros; starts and ends of words."""
    t = _tables()
    joined = "\0".join(texts)
    if not joined.isascii():
        joined = unicodedata.normalize("NFKD", joined)
    codes = np.frombuffer(joined.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = t["alike"][codes[~t["drop"][codes]]]
    # signs and digits between or beside letters are letters
    letter = t["letter"][codes]
    signs = t["signs"][codes] & ~letter
    for _ in range(2):
        near = np.zeros(len(codes), bool)
        near[1:] |= letter[:-1]
        before = near.copy()
        near[:-1] |= letter[1:]
        after = np.zeros(len(codes), bool)
        after[:-1] = letter[1:]
        digit = signs & t["word"][codes] & near
        mark = signs & ~t["word"][codes] & before & after & (codes != ord("!"))
        turned = t["sign"][codes]
        turned = np.where(np.isin(turned, [ord(c) for c in MASKS]), MASK, turned)
        change = digit | mark
        codes = np.where(change, turned, codes)
        letter = letter | change
    # letters repeated three times or more
    new = np.concatenate([[True], codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(codes)))
    codes = codes[new | ~(np.repeat(length, length) >= 3) | ~letter]
    starts, ends = _words(codes)
    # words spelled letter by letter: three or more lone letters, one sign apart
    lone = (ends - starts == 1) & t["letter"][codes[starts]]
    chain = np.zeros(len(starts), bool)
    chain[:-1] = lone[:-1] & lone[1:] & (np.diff(starts) == 2) & (codes[np.minimum(ends[:-1], max(len(codes) - 1, 0))] != 0)
    inside = np.concatenate([[False], chain[:-1]]) & chain
    joint = chain & (inside | np.concatenate([inside[1:], [False]]))
    if joint.any():
        keep = np.ones(len(codes), bool)
        keep[ends[joint]] = False
        codes = codes[keep]
        starts, ends = _words(codes)
    return codes, starts, ends


def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = _tables()
    word = np.concatenate([[False], t["word"][codes] | (codes == MASK), [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    return edge[::2], edge[1::2]


def features(texts: list[str], kinds: dict[int, tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, each one's sentence, and each sentence's text; kinds: the kind's hash and the number of words by a listed term's hash."""
    codes, starts, ends = plain(texts)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = substring_hashes(codes, starts, ends)
    hidden = np.concatenate([[0], np.cumsum(codes == MASK)])
    words = np.where(hidden[ends] > hidden[starts], np.uint64(MASK), words)
    stop = np.isin(codes, [ord(c) for c in ENDS]) | (codes == 0)
    breaks = codes == 0x0A
    breaks[1:] &= codes[:-1] == 0x0A
    stops = np.concatenate([[0], np.cumsum(stop | breaks)])
    sentence = np.concatenate([[0], np.cumsum(stops[starts[1:]] > stops[ends[:-1]])])
    owner = np.searchsorted(np.flatnonzero(codes == 0), starts)
    first = np.flatnonzero(np.concatenate([[True], sentence[1:] != sentence[:-1]]))
    numbers, where = [words], [sentence]
    with np.errstate(over="ignore"):
        two = mix(words[:-1] * np.uint64(3) + mix(words[1:]))
        numbers.append(two), where.append(np.where(sentence[1:] == sentence[:-1], sentence[1:], -1))
        three = mix(two[:-1] * np.uint64(5) + mix(words[2:]))
        numbers.append(three), where.append(np.where(sentence[2:] == sentence[:-2], sentence[2:], -1))
        skip = mix(words[:-2] * np.uint64(7) + mix(words[2:]) + np.uint64(1))
        numbers.append(skip), where.append(where[-1])
    for n in sorted({n for _, n in kinds.values()}):  # listed terms of n words
        if n <= len(words):
            listed = np.array(sorted(t for t, (_, m) in kinds.items() if m == n), np.uint64)
            runs = _sequences(words, n)
            k = np.minimum(np.searchsorted(listed, runs), len(listed) - 1)
            at = np.flatnonzero((listed[k] == runs) & (sentence[n - 1 :] == sentence[: len(runs)]))
            numbers.append(np.array([kinds[int(w)][0] for w in runs[at].tolist()], np.uint64)), where.append(sentence[at])
    number, place = np.concatenate(numbers), np.concatenate(where)
    good = place >= 0
    return (number[good] >> np.uint64(64 - FEATURE_BITS)).astype(np.int64), place[good], owner[first]


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    kinds: dict[int, tuple[int, int]]

    def scores(self, texts: list[str]) -> np.ndarray:
        """Expected severity of each text."""
        number, place, owner = features(texts, self.kinds)
        best = np.full(len(texts), -np.inf)
        if len(owner):
            np.maximum.at(best, owner, np.bincount(place, self.weights[number], len(owner)))
        with np.errstate(over="ignore"):
            return np.where(np.isneginf(best), 0.0, (1 / (1 + np.exp(self.thresholds[:, None] - best))).sum(0))


def term_kinds(terms: list[tuple[str | None, str | None]]) -> dict[int, tuple[int, int]]:
    """The kind's hash and the number of words, by the hash of the term."""
    good = [(t, k) for t, k in terms if t and t.strip() and k]
    out = {}
    for text, kind in good:
        codes, starts, ends = plain([text])
        if len(starts):
            name = np.frombuffer(kind.encode("utf-8", "surrogatepass"), np.uint8)
            out[int(_sequences(substring_hashes(codes, starts, ends), len(starts))[0])] = int(substring_hashes(name, np.array([0]), np.array([len(name)]))[0]), len(starts)
    return out


def _sequences(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    out = words[: len(words) - n + 1]
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out = mix(out * np.uint64(2 * k + 1) + mix(words[k : len(words) - n + 1 + k]))
    return out


@dataclass
class Features:
    """Texts as feature numbers: each one's sentence, and each sentence's text; in_all and in_bad: texts and graded texts that hold a feature of ``used``."""

    texts: int
    used: np.ndarray
    in_all: np.ndarray
    in_bad: np.ndarray
    number: np.ndarray
    place: np.ndarray
    owner: np.ndarray

    def __len__(self) -> int:
        return self.texts


def document_counts(number: np.ndarray, text: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, the texts that hold each, and those of them with a grade above 0."""
    pair = np.unique(number * len(grades) + text)
    of, text = np.divmod(pair, max(1, len(grades)))
    found, at = np.unique(of, return_inverse=True)
    return found, np.bincount(at, minlength=len(found)), np.bincount(at, grades[text] > 0, len(found)).astype(np.int64)


def _extracted(texts: list[str], grades: np.ndarray, kinds: dict) -> Features:
    batches = [slice(k, k + 200) for k in range(0, len(texts), 200)]
    in_all, in_bad = np.zeros(1 << FEATURE_BITS), np.zeros(1 << FEATURE_BITS)
    for part in batches:
        number, place, owner = features(texts[part], kinds)
        found, n_all, n_bad = document_counts(number, owner[place], grades[part])
        in_all[found] += n_all
        in_bad[found] += n_bad
    used = np.flatnonzero(in_all >= LEAST_DOCS)
    parts, sentences = [], 0
    for part in batches:
        number, place, owner = used_features(features(texts[part], kinds), used)
        parts.append((number, place + sentences, owner + part.start))
        sentences += len(owner)
    return Features(len(texts), used, in_all[used], in_bad[used], *(np.concatenate(p) for p in zip(*parts, strict=True)))


def used_features(found: tuple[np.ndarray, np.ndarray, np.ndarray], used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places in ``used`` of those features that are, sorted by sentence."""
    number, place, owner = found
    at = np.minimum(np.searchsorted(used, number), max(0, len(used) - 1))
    keep = used[at] == number if len(used) else np.zeros(len(number), bool)
    at, place = at[keep], place[keep]
    order = np.argsort(place, kind="stable")
    return at[order].astype(np.int32), place[order].astype(np.int32), owner


def fit(texts: list[str] | Features, grades: np.ndarray, kinds: dict) -> Model:
    """Cumulative-link weights on the worst sentence of each text."""
    weights, size = np.zeros(1 << FEATURE_BITS), 1 << FEATURE_BITS
    grades = np.asarray(grades)
    if len(texts) == 0 or not (grades == 0).any() or not (grades > 0).any():
        for k, _ in set(kinds.values()):
            weights[k >> (64 - FEATURE_BITS)] = 4.0
        return Model(weights, np.array([2.0, 3.0]), kinds)
    # features seen in few texts say nothing
    f = texts if isinstance(texts, Features) else _extracted(texts, grades, kinds)
    used, in_all, in_bad, number, owner = f.used, f.in_all, f.in_bad, f.number, f.owner
    n_bad, n_good = float((grades > 0).sum()), float((grades == 0).sum())
    odds = np.log((in_bad + 0.5) / (n_bad + 1)) - np.log((in_all - in_bad + 0.5 * n_good / n_bad) / (n_good + 1))
    weights = np.clip(odds, -2, 2) * 0.3
    thresholds = np.array([2.0, 2.5])
    m, v, mt, vt = np.zeros(len(used)), np.zeros(len(used)), np.zeros(2), np.zeros(2)
    bounds = np.searchsorted(f.place, np.arange(len(owner) + 1))
    filled = np.flatnonzero(np.diff(bounds))
    score = np.zeros(len(owner), np.float32)
    of_doc = np.searchsorted(owner, np.arange(len(texts) + 1))
    full = of_doc[1:] > of_doc[:-1]
    docs = np.flatnonzero(full)
    y = grades[docs]
    logistic = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(1, STEPS + 1) if len(filled) else ():
        score[filled] = np.add.reduceat(weights.astype(np.float32)[number], bounds[filled])
        z = np.maximum.reduceat(score, of_doc[:-1][full])
        top = np.flatnonzero(score == np.repeat(z, np.diff(of_doc)[full]))
        worst = top[np.searchsorted(owner[top], docs)]
        z = z.astype(np.float64)
        p0, p1 = logistic(z - thresholds[0]), logistic(z - thresholds[1])
        d0, d1 = p0 * (1 - p0), p1 * (1 - p1)
        between = np.maximum(p0 - p1, 1e-9)
        g0 = np.where(y == 0, p0, np.where(y == 1, -d0 / between, 0.0))  # derivative of the loss by z - threshold 0
        g1 = np.where(y == 2, p1 - 1, np.where(y == 1, d1 / between, 0.0))
        g = g0 + g1
        n = bounds[worst + 1] - bounds[worst]
        at = np.repeat(bounds[worst], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        grad = np.bincount(number[at], np.repeat(g, n), len(used)) / len(docs) + RIDGE * weights
        grad_t = np.array([-g0.sum(), -g1.sum()]) / len(docs)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mt, vt = 0.9 * mt + 0.1 * grad_t, 0.99 * vt + 0.01 * grad_t * grad_t
        c, c2 = 1 - 0.9**step, 1 - 0.99**step
        rate = RATE * (1 - step / (STEPS + 1))
        weights = weights - rate * (m / c) / (np.sqrt(v / c2) + 1e-4)
        thresholds = thresholds - rate * (mt / c) / (np.sqrt(vt / c2) + 1e-4)
        thresholds[1] = max(thresholds[1], thresholds[0] + 0.05)
    full_weights = np.zeros(size)
    full_weights[used] = weights
    return Model(full_weights, thresholds, kinds)


# -- Spark ---------------------------------------------------------------------------------------------------------


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) by the reviewers' latest votes: 0 none, 1 disputed, 2 agreed."""
    votes = labels.select("doc_id", F.lower(F.trim("reviewer")).alias("reviewer"), F.col("toxic").cast("int").alias("toxic"), "labelled_at").filter("doc_id IS NOT NULL AND toxic IN (0, 1)")
    latest = Window.partitionBy("doc_id", "reviewer").orderBy(F.desc_nulls_last("labelled_at"), F.desc("toxic"))
    votes = votes.withColumn("r", F.row_number().over(latest)).filter("r = 1")
    share = votes.groupBy("doc_id").agg(F.avg("toxic").alias("share"))
    return share.select("doc_id", F.when(F.col("share") == 0, 0).when(F.col("share") == 1, 2).otherwise(1).alias("grade"))


def fit_model(docs: DataFrame, labels: DataFrame, terms: DataFrame, most: int = MAX_LABELLED) -> Model:
    listed = terms.select("term", "kind").dropna().distinct()
    kinds = term_kinds([(r[0], r[1]) for r in listed.toLocalIterator()])  # the list is part of the model, which goes to every task
    chosen = graded(labels).withColumn("h", F.xxhash64("doc_id")).orderBy("h", "doc_id").limit(most).drop("h")
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("grade").cast("long").alias("grade")).select("text", "grade")
    rows = checkpointed(rows.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism))  # at most ``most`` rows, read twice
    counted = mapped(rows, _count_features(kinds), "number bigint, n_all bigint, n_bad bigint").groupBy("number").agg(F.sum("n_all").alias("n_all"), F.sum("n_bad").alias("n_bad"))
    counted = counted.filter(F.col("n_all") >= LEAST_DOCS).orderBy("number").toArrow()  # at most 2**FEATURE_BITS rows
    used, in_all, in_bad = (counted.column(c).to_numpy() for c in ("number", "n_all", "n_bad"))
    lists = mapped(rows, _list_features(kinds, used), "grade bigint, sizes array<int>, numbers array<int>").toArrow()
    grades = lists.column("grade").to_numpy()
    sizes, numbers = (lists.column(c).combine_chunks() for c in ("sizes", "numbers"))
    in_text, in_sentence = sizes.value_lengths().to_numpy(zero_copy_only=False), sizes.flatten().to_numpy(zero_copy_only=False)
    place = np.repeat(np.arange(len(in_sentence), dtype=np.int32), in_sentence)
    return fit(Features(len(grades), used, in_all, in_bad, numbers.flatten().to_numpy(zero_copy_only=False), place, np.repeat(np.arange(len(grades)), in_text)), grades, kinds)


def _few(batch: pa.RecordBatch) -> Iterator[tuple[list[str], np.ndarray]]:
    """Texts and grades of a batch, about CHUNK characters at a time."""
    grades, texts, begin, held = batch.column(1).to_numpy(), [], 0, 0
    for k, text in enumerate(batch.column(0)):
        texts.append(text.as_py())
        held += len(texts[-1])
        if held >= CHUNK or k == batch.num_rows - 1:
            yield texts, grades[begin : k + 1]
            texts, begin, held = [], k + 1, 0


def _count_features(kinds: dict) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, grades in _few(batch):
                number, place, owner = features(texts, kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in document_counts(number, owner[place], grades)], names=["number", "n_all", "n_bad"])

    return run


def _list_features(kinds: dict, used: np.ndarray) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, grades in _few(batch):
                number, place, owner = used_features(features(texts, kinds), used)
                sizes = np.bincount(place, minlength=len(owner)).astype(np.int32)
                sentences = np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32)
                ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sentences), pa.array(sizes)), pa.ListArray.from_arrays(pa.array(ends[sentences]), pa.array(number))
                yield pa.RecordBatch.from_arrays([pa.array(grades), *lists], names=["grade", "sizes", "numbers"])

    return run


def score(docs: DataFrame, model: Model, spark: SparkSession, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, keep..., severity) of every document."""
    shared = spark.sparkContext.broadcast(Model(model.weights.astype(np.float32), model.thresholds, model.kinds))
    fields = [f for f in docs.select("doc_id", *keep).schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            out = np.zeros(len(column))
            waiting, rows, held = [], [], 0
            for k, text in enumerate(column):
                text = text.as_py()
                if text:
                    waiting.append(text)
                    rows.append(k)
                    held += len(text)
                if waiting and (held >= CHUNK or k == len(column) - 1):
                    out[rows] = shared.value.scores(waiting)
                    waiting, rows, held = [], [], 0
            if waiting:
                out[rows] = shared.value.scores(waiting)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*(f.name for f in fields), "severity"])

    schema = docs.select("doc_id", *keep).schema.add("severity", "double")
    return mapped(docs.select("doc_id", *keep, "text"), run, schema)


def _scored(spark, d: str, keep: tuple[str, ...] = ()) -> DataFrame:
    from castgraph.sources import table

    docs = table(spark, d, "documents")
    return score(docs, fit_model(docs, table(spark, d, "review_labels"), table(spark, d, "toxic_terms")), spark, keep)


def p8_scores(spark, d: str) -> DataFrame:
    return _scored(spark, d)


def p8_found(spark, d: str) -> DataFrame:
    return _scored(spark, d).filter(F.col("severity") >= CASE).select("doc_id")


def p8_rates(spark, d: str) -> DataFrame:
    """Documents, cases and their share per source (case and outer blanks ignored; null sources together)."""
    rows = _scored(spark, d, ("source",)).select(F.lower(F.trim("source")).alias("source"), "severity")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.sum((F.col("severity") >= CASE).cast("bigint")).alias("n_cases"), F.avg((F.col("severity") >= CASE).cast("double")).alias("rate"), F.avg("severity").alias("mean_severity"))


QUERIES = {"p8_found": p8_found, "p8_scores": p8_scores, "p8_rates": p8_rates}
SQL: dict[str, str] = {}
