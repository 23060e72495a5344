"""Evaluation texts leaking into training text.

Texts become sequences of words (lower case, NFKD, no combining marks or format characters, words cut at line ends joined);
a word is its 64-bit hash.  A passage of an item is a window of ``window`` consecutive words, or the whole item if shorter.

A window of n words permits ``max_edits`` edits, but at most n - 1, so that a match always keeps a word.

Search.  Every window is embedded by the CGK random walk: a pointer walks over the window, step j emits the word
under the pointer and moves on iff bit j of that word's (per-repeat) hash is set.  Two windows at a small word edit distance
get embeddings at a small Hamming distance with good chance; equal windows always get equal ones.  Bit-sampling LSH takes SAMPLES
positions of the embedding per repeat; windows of texts that share a sample with an item's window are candidates.
``repeats`` is chosen from ``max_edits`` for the target recall (measured in the tests).  Candidates are verified by the
exact edit distance between the word sequences, whatever the number of edits.  Walks from one word are shared by all window lengths.

A window of a text can lie within ``max_edits`` of an item's window only if all but ``max_edits`` of its words occur in
items' windows of that length; the other windows are skipped before the walk, which loses nothing.

Scale.  Documents never leave their task: no shuffle but the final distinct on (document, item).  The index over the items
is broadcast in blocks of at most INDEX_BYTES, one pass over the texts per block, so its size is bounded whatever the items' number or length
(a longer item is cut into overlapping parts).

Defined results: null and empty texts and items without words match nothing; a document is reported once per item however
often it matches; equal items are each reported; repeated doc_ids are one document in the result; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.functions import mapped
from castgraph.llm.wordhash import mix, substring_hashes, word_classes

WINDOW, STEPS, SEED = 10, 2, 7
VERIFY = 1 << 16  # candidates compared at once
CHUNK = 1 << 18  # characters worked on at once
INDEX_BYTES = 256 << 20
#: Repeats of the embedding by permitted word edits; 1 suffices for equal windows, whose embeddings are equal.
REPEATS = {0: 1, 1: 24, 2: 80}
SAMPLES = {0: 6, 1: 6, 2: 5}
#: A word cut by a hyphen at a line's end, whose rest may stand behind quote marks.
_CUT = re.compile("[-‐](?<=[^\\W_].)[^\\S\r\n  \x85]*(?:\r\n|[\n\r  \x85])[>\\s]*(?=[^\\W_])")
_PAD = np.uint64(0)


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of all texts, and the index of each word's text."""
    joined = "\0".join(texts)
    if not joined.isascii():
        joined = unicodedata.normalize("NFKD", joined)
    joined = joined.lower()
    classes = word_classes()
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    drop = classes[codes] == 2
    if drop.any():
        codes = codes[~drop]
        joined = codes.tobytes().decode("utf-32-le", "surrogatepass")
    if _CUT.search(joined):
        joined = _CUT.sub("", joined)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.concatenate([[False], classes[codes] == 1, [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edge[::2], edge[1::2]
    owner = np.searchsorted(np.flatnonzero(codes == 0), starts)
    return substring_hashes(codes, starts, ends) | np.uint64(1), owner


def embed(windows: np.ndarray, repeat: int, steps: int) -> np.ndarray:
    """The CGK walk of each row of words: rows x steps."""
    n, length = windows.shape
    with np.errstate(over="ignore"):
        turns = mix(windows * np.uint64(2 * (SEED + repeat) + 1) + np.uint64(repeat))
    at, rows = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, steps), np.uint64)
    for j in range(steps):
        inside = at < length
        here = np.minimum(at, length - 1)
        out[:, j] = np.where(inside, windows[rows, here], _PAD)
        at += np.where(inside, (turns[rows, here] >> np.uint64(j % 64)) & np.uint64(1), 0).astype(np.int64)
    return out


def signatures(windows: np.ndarray, repeat: int, samples: int, width: int) -> np.ndarray:
    """The sampled positions of the embedding in one 64-bit value."""
    pick = np.random.default_rng([SEED, repeat, width]).choice(width, min(samples, width), replace=False)
    walk = embed(windows, repeat, width)
    sig = np.full(len(windows), 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in pick:
            sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + walk[:, j])
    return sig


def edit_distances(a: np.ndarray, b: np.ndarray, most: int | None = None) -> np.ndarray:
    """Word edit distance of each pair of rows; above ``most`` some number above it, for only the diagonals within it are followed."""
    n, la = a.shape
    lb = b.shape[1]
    most = max(la, lb) if most is None else most
    far = np.int64(1 << 30)
    if abs(la - lb) > most:
        return np.full(n, far)
    # row[d]: distance between the first i words of a and the first i + d - most of b
    shift = np.arange(-most, most + 1)
    row = np.broadcast_to(np.where((shift >= 0) & (shift <= lb), shift, far), (n, len(shift))).copy()
    for i in range(1, la + 1):
        new = np.full((n, len(shift)), far)
        for d in range(len(shift)):
            j = i + d - most
            if not 0 <= j <= lb:
                continue
            best = row[:, d] + (a[:, i - 1] != b[:, j - 1]) if j else np.full(n, i)
            if d + 1 < len(shift):
                best = np.minimum(best, row[:, d + 1] + 1)
            if d and j:
                best = np.minimum(best, new[:, d - 1] + 1)
            new[:, d] = best
        row = new
    return row[:, lb - la + most]


def within_one(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The word edit distance where it is 0 or 1, else 2."""
    return np.minimum(edit_distances(a, b, 1), 2)


class Index:
    """Windows of the items by length, and their signatures of each repeat, sorted."""

    def __init__(self, item_ids: list[int], texts: list[str], window: int, max_edits: int):
        words, owner = words_of(texts) if texts else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self._build(np.array(item_ids, np.int64), words, np.bincount(owner, minlength=len(texts)), window, max_edits)

    @classmethod
    def of_words(cls, item_ids: list[int], words: list[np.ndarray], window: int, max_edits: int) -> Index:
        out = cls.__new__(cls)
        out._build(np.array(item_ids, np.int64), np.concatenate([np.zeros(0, np.uint64), *words]), np.array([len(w) for w in words], np.int64), window, max_edits)
        return out

    def _build(self, items: np.ndarray, words: np.ndarray, counts: np.ndarray, window: int, max_edits: int) -> None:
        self.window, self.max_edits, self.repeats = window, max_edits, repeats_for(max_edits)
        begins = np.cumsum(counts) - counts
        self.known: dict[int, np.ndarray] = {}  # the words of the windows of each length
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]] = {}
        for length in sorted(set(np.minimum(counts[counts > 0], window).tolist())):
            mine = np.flatnonzero((counts >= window) if length == window else (counts == length))
            n = counts[mine] - length + 1
            at = np.repeat(begins[mine], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            windows = words[at[:, None] + np.arange(length)]
            tables = []
            for r in range(self.repeats):
                sig = signatures(windows, r, self.samples(length), STEPS * length)
                order = np.argsort(sig, kind="stable").astype(np.int32)
                tables.append((sig[order], order))
            self.by_length[length] = (windows, items[np.repeat(mine, n)], tables)
            self.known[length] = np.unique(windows)

    def samples(self, length: int) -> int:
        return max(1, min(SAMPLES.get(self.max_edits, 2), length // 2))

    def matches(self, words: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """(text, item, word position, edits) of every verified window."""
        found = [np.zeros((0, 4), np.int64)]
        if not len(words):
            return found[0]
        for length, (windows, items, tables) in self.by_length.items():
            known = self.known[length]
            k = np.minimum(np.searchsorted(known, words), len(known) - 1)
            strange = np.concatenate([[0], np.cumsum(known[k] != words)])
            edits = min(self.max_edits, length - 1)
            # with edits a passage may be shorter or longer than the item's window
            sizes = [own for own in range(length - edits, length + edits + 1) if own <= len(words)]
            usable = np.zeros((len(sizes), len(words)), bool)
            for u, own in zip(usable, sizes, strict=True):
                begin = np.arange(len(words) - own + 1)
                u[begin] = (strange[begin + own] - strange[begin] <= edits) & (owner[begin] == owner[begin + own - 1])
            begin = np.flatnonzero(usable.any(0))
            if not len(begin):
                continue
            usable = usable[:, begin]
            met = [[] for _ in sizes]
            for r, (sig, order) in enumerate(tables):
                for s, use, own, out in zip(_shared_signatures(words, begin, sizes, r, self.samples(length), STEPS * length), usable, sizes, met, strict=True):
                    mine = np.flatnonzero(use)
                    lo, hi = np.searchsorted(sig, s[mine], "left"), np.searchsorted(sig, s[mine], "right")
                    n = hi - lo
                    left = np.repeat(mine, n)
                    right = order[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)].astype(np.int64)
                    if edits == 1 and own > 1:  # one edit leaves the first or the last word as it is
                        near = (words[begin[left]] == windows[right, 0]) | (words[begin[left] + own - 1] == windows[right, -1])
                        left, right = left[near], right[near]
                    out.append(left * len(windows) + right)
            for own, candidates in zip(sizes, met, strict=True):
                left, right = np.divmod(np.unique(np.concatenate(candidates)), len(windows))  # each candidate is verified once
                for k in range(0, len(left), VERIFY):
                    a, b = begin[left[k : k + VERIFY]], right[k : k + VERIFY]
                    distance = edit_distances(words[a[:, None] + np.arange(own)], windows[b], edits)
                    good = distance <= edits
                    a, b = a[good], b[good]
                    found.append(np.stack([owner[a], items[b], a, distance[good]], 1).astype(np.int64))
        return np.concatenate(found)


def repeats_for(max_edits: int) -> int:
    return REPEATS.get(max_edits, 40 * max_edits)


def _shared_signatures(words: np.ndarray, begin: np.ndarray, sizes: list[int], repeat: int, samples: int, width: int) -> list[np.ndarray]:
    """``signatures`` of the windows of each size that begin at the given words: the walk from a word is the same for all sizes until it leaves the window."""
    pick = np.random.default_rng([SEED, repeat, width]).choice(width, min(samples, width), replace=False)
    with np.errstate(over="ignore"):
        turns = mix(words * np.uint64(2 * (SEED + repeat) + 1) + np.uint64(repeat))
        at, end, seen = begin.copy(), len(words) - 1, {}
        for j in range(int(pick.max()) + 1):
            if j in pick:
                seen[j] = at.copy()
            at = np.minimum(at + ((turns[at] >> np.uint64(j % 64)) & np.uint64(1)).astype(np.int64), end + 1)
            if j < int(pick.max()):
                over = at > end
                if over.any():  # beyond the last word: no window of any size holds it
                    turns, words, end = np.append(turns, np.uint64(0)), np.append(words, _PAD), end + 1
        out = []
        for own in sizes:
            sig = np.full(len(begin), 1, np.uint64)
            for j in pick:
                place = seen[j]
                inside = place - begin < own
                sig = mix(sig * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, words[np.minimum(place, end)], _PAD))
            out.append(sig)
        return out


def _search(index) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, waiting, ids, held = [], [], [], 0

            def flush() -> None:
                words, owner = words_of(waiting)
                got = index.value.matches(words, owner)
                if len(got):
                    frame = pd.DataFrame({"t": got[:, 0], "item_id": got[:, 1], "at": got[:, 2], "edits": got[:, 3]})
                    best = frame.groupby(["t", "item_id"]).agg(n_windows=("at", "nunique"), edits=("edits", "min")).reset_index()
                    best.insert(0, "doc_id", np.array(ids)[best.t])
                    out.append(best.drop(columns="t"))

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                if not text or doc is None:
                    continue
                waiting.append(text)
                ids.append(doc)
                held += len(text)
                if held >= CHUNK:
                    flush()
                    waiting, ids, held = [], [], 0
            if waiting:
                flush()
            if out:
                yield pa.RecordBatch.from_pandas(pd.concat(out), pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64()), ("edits", pa.int64())]), preserve_index=False)

    return run


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, max_edits: int) -> Iterator[tuple[list[int], list[np.ndarray]]]:
    """Items as words, in blocks whose index has at most INDEX_BYTES, streamed to the driver."""
    most = INDEX_BYTES // (8 * (window + 2) + 12 * repeats_for(max_edits))  # of a window of each word
    ids, words, held = [], [], 0
    for row in items.select(id_col, text_col).dropna().orderBy(id_col).toLocalIterator():
        rest = words_of([row[1]])[0]
        while len(rest):
            part = rest[:most]
            rest = rest[len(part) - window + 1 :] if len(rest) > len(part) else rest[:0]
            if held + len(part) > most and held:
                yield ids, words
                ids, words, held = [], [], 0
            ids.append(row[0]), words.append(part)
            held += len(part)
    yield ids, words


def leaked(docs: DataFrame, items: DataFrame, spark: SparkSession, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, max_edits: int = 0) -> DataFrame:
    """(doc_id, item_id, n_windows, edits): documents that hold a passage of an item, with the number of matching windows and the fewest edits."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    passes = []
    for ids, words in _blocks(items, item_id, item_text, window, max_edits):
        index = spark.sparkContext.broadcast(Index.of_words(ids, words, window, max_edits))
        passes.append(mapped(texts, _search(index), "doc_id bigint, item_id bigint, n_windows bigint, edits bigint"))
    return reduce(DataFrame.unionByName, passes).groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.min("edits").alias("edits"))


def _tables(spark, d: str) -> tuple[DataFrame, DataFrame]:
    from castgraph.sources import table

    return table(spark, d, "documents"), table(spark, d, "eval_items")


def p7_found(spark, d: str) -> DataFrame:
    """The passages of p7_near that need no edit."""
    return p7_near(spark, d).filter("edits = 0").select("doc_id", "item_id")


def p7_near(spark, d: str) -> DataFrame:
    """Also passages in which one word of ten was added, dropped or changed."""
    return leaked(*_tables(spark, d), spark, max_edits=1)


def p7_items(spark, d: str) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return p7_found(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("n_documents"))


QUERIES = {"p7_found": p7_found, "p7_near": p7_near, "p7_items": p7_items}
SQL: dict[str, str] = {}
