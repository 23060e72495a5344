"""Encoding of a corpus with a public byte-level BPE vocabulary.

Pre-tokens are found for a whole chunk of texts at once, from arrays of character classes (the public pattern's
alternatives are decided by class changes, one look ahead and the contractions).  Each pre-token is then looked up in
two tiers:

1. a minimal perfect hash over the vocabulary: bucket and displacement, all pre-tokens of a chunk in a few array
   operations; a slot's bytes are then compared with the pre-token's;
2. for the rest, the merges: a heap of mergeable neighbours over linked bytes, lowest rank first, leftmost on ties.  A
   bounded memo in each worker keeps results of repeated pre-tokens.

Entries of the vocabulary that the merges would not reach on their own are left out of tier 1, so both tiers agree with
the plain algorithm.  The vocabulary is read on the driver and broadcast; its size is fixed (50,257 entries, about 1 MB).

Defined results: null and empty texts give an empty list; special tokens' strings are ordinary text; repeated ids are
encoded each; texts of any length are whole (a long one is worked through in parts that end before white space, where
a pre-token always ends); other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.functions import mapped
from castgraph.llm.wordhash import LETTER, OTHER, SPACE, substring_hashes, token_classes

TOKENIZERS = os.environ.get("CASTGRAPH_TOKENIZERS", "/opt/tokenizers")
CHUNK = 1 << 18  # characters worked on at once
MEMO = 1 << 17
#: Contractions that are pre-tokens of their own. Fixed values.
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


# -- tier 2: merges --------------------------------------------------------------------------------------------


def merge_bytes(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a pre-token by its merges."""
    n = len(word)
    if n == 1:
        return [ranks[word]]
    right, left, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, size = heapq.heappop(heap)
        j = right[i] if end[i] else n
        if not end[i] or j >= n or end[j] - i != size:
            continue  # one of the two is gone or has grown
        end[i], end[j] = end[j], 0
        right[i] = right[j]
        if right[j] < n:
            left[right[j]] = i
        if (k := left[i]) >= 0 and (r := ranks.get(word[k : end[i]])) is not None:
            heapq.heappush(heap, (r, k, end[i] - k))
        if (k := right[i]) < n and (r := ranks.get(word[i : end[k]])) is not None:
            heapq.heappush(heap, (r, i, end[k] - i))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = right[i]
    return out


# -- tier 1: minimal perfect hash ------------------------------------------------------------------------------


class PerfectHash:
    """A minimal perfect hash of byte strings: as many slots as keys."""

    def __init__(self, keys: list[bytes], values: list[int]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n * 2 // 5)
        flat = np.frombuffer(b"".join(keys), np.uint8)
        ends = np.cumsum([len(k) for k in keys]) if keys else np.zeros(0, np.int64)
        starts = ends - np.array([len(k) for k in keys], np.int64)
        a, b = (substring_hashes(flat, starts, ends, k) for k in (0, 1))
        self.shift = np.zeros(self.buckets, np.int64)
        taken = np.zeros(n, bool)
        slots = np.zeros(len(keys), np.int64)
        bucket = self._bucket(a)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        groups = sorted((order[bounds[i] : bounds[i + 1]] for i in range(self.buckets) if bounds[i] < bounds[i + 1]), key=len, reverse=True)
        alone = []
        for g in groups:
            if len(g) == 1:
                alone.append(g[0])
                continue
            first, span = 0, 16
            while True:  # displacements in growing spans
                tried = self._slot(a[g][:, None], b[g][:, None], np.arange(first, first + span, dtype=np.uint64))
                free = ~taken[tried].any(0)
                for c in np.flatnonzero(free):
                    if len(np.unique(tried[:, c])) == len(g):
                        break
                else:
                    first, span = first + span, min(span * 2, 1 << 16)
                    continue
                slots[g], self.shift[bucket[g[0]]] = tried[:, c], first + c
                taken[tried[:, c]] = True
                break
        for key, slot in zip(alone, np.flatnonzero(~taken), strict=False):  # a lone key goes straight to a free slot
            slots[key], self.shift[bucket[key]] = slot, -slot - 1
        self.length, self.value = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        self.head, self.tail, self.key = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, object)
        self.length[slots], self.value[slots], self.key[slots] = ends - starts, values, keys
        self.head[slots], self.tail[slots] = _ends_of(flat, starts, ends)

    def _bucket(self, a: np.ndarray) -> np.ndarray:
        return ((a >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.int64)

    def _slot(self, a: np.ndarray, b: np.ndarray, shift: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (((b >> np.uint64(7)) + shift * ((a & np.uint64(0xFFFFFFFF)) | np.uint64(1))) % np.uint64(self.n)).astype(np.int64)

    def lookup(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The value of each key flat[start:end], -1 if there is none."""
        a, b = (substring_hashes(flat, starts, ends, k) for k in (0, 1))
        shift = self.shift[self._bucket(a)]
        slot = np.where(shift < 0, -shift - 1, self._slot(a, b, shift.astype(np.uint64)))
        head, tail = _ends_of(flat, starts, ends)
        hit = (self.length[slot] == ends - starts) & (self.head[slot] == head) & (self.tail[slot] == tail)
        for k in np.flatnonzero(hit & (ends - starts > 16)).tolist():  # the first and last eight bytes are the whole of shorter keys
            hit[k] = flat[starts[k] : ends[k]].tobytes() == self.key[slot[k]]
        return np.where(hit, self.value[slot], -1)


def _ends_of(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first and the last eight bytes of each substring, as numbers; shorter ones filled up with zeros."""
    padded = np.concatenate([np.zeros(8, np.uint8), flat, np.zeros(8, np.uint8)]).tobytes()
    eight = np.ndarray((len(flat) + 9,), "<u8", padded, 0, (1,))
    short = (8 * np.minimum(ends - starts, 8)).astype(np.uint64)
    mask = np.where(short == 64, ~np.uint64(0), (np.uint64(1) << (short % np.uint64(64))) - np.uint64(1))
    head = eight[starts + 8] & mask
    return head, np.where(ends - starts > 8, eight[ends], head)


@lru_cache(2)
def load_vocabulary(path: str) -> tuple[dict[bytes, int], PerfectHash]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    whole = [(w, r) for w, r in ranks.items() if merge_bytes(w, ranks) == [r]]
    return ranks, PerfectHash([w for w, _ in whole], [r for _, r in whole])


# -- pre-tokens ---------------------------------------------------------------------------------------------------


def token_starts(codes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether a pre-token starts at each character; first: whether a text does."""
    n = len(codes)
    cls = token_classes()[codes]
    start = first.copy()
    start[0] = True
    start[1:] |= cls[1:] != cls[:-1]
    # the last white space before another character stands alone, and a blank joins what follows
    after = np.flatnonzero(start[1:] & (cls[1:] != SPACE) & (cls[:-1] == SPACE) & ~first[1:]) + 1
    start[after - 1] = True
    start[after[codes[after - 1] == 0x20]] = False
    at = np.flatnonzero((codes == 0x27) & start)
    at = at[at + 1 < n]
    at = at[(cls[at] == OTHER) & (cls[at + 1] == LETTER) & ~first[at + 1]]
    for tail in CONTRACTIONS:
        k = len(tail)
        fits = at[at + k < n]
        for j, ch in enumerate(tail, 1):
            fits = fits[(codes[fits + j] == ord(ch)) & ~first[fits + j]]
        start[fits + 1] = False
        behind = fits + k + 1
        start[behind[behind < n]] = True
    return start


def _parts(text: str) -> list[str]:
    """A text in parts of about CHUNK characters, cut before white space that follows something else."""
    out, a = [], 0
    while len(text) - a > 2 * CHUNK:
        b = a + CHUNK
        while b < len(text) and not (text[b] in " \n\t\r" and not text[b - 1].isspace() and not "\x1c" <= text[b - 1] <= "\x1f"):
            b += 1
        out.append(text[a:b])
        a = b
    return [*out, text[a:]]


class Encoder:
    def __init__(self, ranks: dict[bytes, int], perfect: PerfectHash):
        self.ranks, self.perfect, self.memo = ranks, perfect, {}

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        joined = "".join(texts)
        raw = joined.encode("utf-8", "surrogatepass")
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        bounds = np.concatenate([[0], np.cumsum(lengths)])
        first = np.zeros(len(codes) + 1, bool)
        first[bounds[:-1]] = True
        at = np.flatnonzero(token_starts(codes, first[:-1]))
        if len(raw) == len(codes):
            starts, total = at, len(codes)
        else:
            width = 1 + (codes >= 0x80).astype(np.int64) + (codes >= 0x800) + (codes >= 0x10000)
            place = np.concatenate([[0], np.cumsum(width)])
            starts, total = place[at], int(place[-1])
        ends = np.append(starts[1:], total)
        flat = np.frombuffer(raw, np.uint8)
        ids = self.perfect.lookup(flat, starts, ends)
        counts = np.ones(len(ids), np.int64)
        missed = np.flatnonzero(ids < 0)
        if len(missed):
            place: dict[bytes, int] = {}  # told apart by their bytes
            which = np.fromiter((place.setdefault(raw[i:j], len(place)) for i, j in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True)), np.int64, len(missed))
            merged = [self._merged(word) for word in place]
            sizes = np.fromiter(map(len, merged), np.int64, len(merged))
            begins = np.cumsum(sizes) - sizes
            every = np.fromiter((x for m in merged for x in m), np.int64, int(sizes.sum()))
            counts[missed] = sizes[which]
        places = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        out[places[ids >= 0]] = ids[ids >= 0]
        if len(missed):
            n = counts[missed]
            within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            out[np.repeat(places[missed], n) + within] = every[np.repeat(begins[which], n) + within]
        owner = np.searchsorted(bounds, at, side="right") - 1  # empty texts own no character
        return out, np.bincount(owner, counts, len(texts)).astype(np.int64)

    def _merged(self, word: bytes) -> list[int]:
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            got = self.memo[word] = merge_bytes(word, self.ranks)
        return got

    def encode_column(self, texts: pa.Array) -> pa.ListArray:
        """The ids of each text; all ids of the texts must number less than 2**31, as they do for less than 2**29 characters."""
        ids = []
        waiting: list[str] = []
        owners: list[int] = []
        held = 0

        def flush() -> None:
            out, n = self.encode(waiting)
            ids.append(out)
            np.add.at(total, np.array(owners, np.int64), n)

        total = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            text = text.as_py()
            if not text:
                continue
            for part in _parts(text) if len(text) > 2 * CHUNK else (text,):
                waiting.append(part)
                owners.append(k)
                held += len(part)
                if held >= CHUNK:
                    flush()
                    waiting, owners, held = [], [], 0
        if waiting:
            flush()
        offsets = np.concatenate([[0], np.cumsum(total)])
        if offsets[-1] >= 1 << 31:
            raise ValueError("too many ids for one list column; encode fewer texts at once")
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))


def _bounded(texts: pa.Array, most: int = 1 << 29) -> list[tuple[int, int]]:
    """Runs of texts of less than ``most`` bytes together, or of one text."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    out, begin, held = [], 0, 0
    for k, n in enumerate(sizes.tolist()):
        if held and n and held + n >= most:
            out.append((begin, k))
            begin, held = k, 0
        held += n
    return [*out, (begin, len(sizes))]


_ENCODERS: dict[str, Encoder] = {}  # of this worker, by the vocabulary's path


def encode_corpus(df: DataFrame, spark: SparkSession, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every text."""
    path = path or f"{TOKENIZERS}/byte_bpe_50k.tiktoken"
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.get(path)
        if encoder is None:
            _ENCODERS.clear()
            encoder = _ENCODERS[path] = Encoder(*shared.value)
        for batch in batches:
            for a, b in _bounded(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], encoder.encode_column(batch.column(1)[a:b])], names=["doc_id", "ids"])

    return mapped(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id bigint, ids array<int>")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from castgraph.sources import table

    return encode_corpus(table(spark, d, "documents"), spark)


QUERIES = {"p6_ids": p6_ids}
SQL: dict[str, str] = {}
