"""Splitting oversized texts at natural boundaries.

Every text longer than ``limit`` code points becomes ordered pieces of at most ``limit``.  Cut positions are chosen by
dynamic programming over the text's boundary positions: the cost of a plan is the sum of its cuts' penalties plus the
squared relative deviation of each piece from the even size.  Boundaries are ranked in tiers (end of a speech, of a
paragraph, of a line, of a sentence, of a word, any character); the program runs on the coarsest tiers that
admit a plan, so a word is never cut where a sentence end would do, and no text is too long: time is linear in it.

A piece starts ``overlap`` characters before the previous cut, or at the next word start behind that point if
the point lies inside a word; where there is no word start before the cut, exactly ``overlap`` characters before it.

Defined results: null, empty and short texts give no pieces; a word that is
longer than a piece is cut inside, before a base character where there is one; so is a run of blanks that is longer than a piece; equal plans: the earlier cuts win; rows with
the same id are split each on its own; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.functions import mapped

LIMIT, OVERLAP = 3000, 200
MARKS = 64  # more combining marks than this on one character are cut anywhere
#: Tiers from coarse to fine and the penalty of a cut there. Fixed values.
PENALTY = {"speech": 0.0, "paragraph": 0.5, "line": 1.5, "sentence": 2.0, "word": 60.0, "character": 4000.0}
#: Line ends and the marks that end a sentence or may close it. Fixed values.
LINE_ENDS = (0x0A, 0x0D, 0x85, 0x2028, 0x2029)
ENDERS = tuple(map(ord, ".!?…。！？"))
CLOSERS = tuple(map(ord, "\"'”’»)]“"))
#: A line that opens a speech: a name in capitals with a colon or stop, or a name with a colon.
_SPEECH = re.compile(r"[>\s]*(?:[^\W\d_a-z][^\n:.]{0,40}:\s|[^\W\d_a-z][^\Wa-z ]*(?:[ .'’-][^\Wa-z ]+)*\.\s)")


@lru_cache(1)
def _blank() -> np.ndarray:
    return np.array([chr(i).isspace() for i in range(0x110000)], bool)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions behind which a cut is natural (word starts), and each one's tier number, the best that applies."""
    codes = _codes(text)
    blank = _blank()[codes]
    at = np.flatnonzero(~blank[1:] & blank[:-1]) + 1
    filled = np.flatnonzero(~blank)
    k = np.searchsorted(filled, at) - 1
    at, k = at[k >= 0], k[k >= 0]
    before = filled[k]  # the last character of the word before
    ends = np.isin(codes, LINE_ENDS)
    ends[1:] &= ~((codes[1:] == 0x0A) & (codes[:-1] == 0x0D))
    lines = np.concatenate([[0], np.cumsum(ends)])
    lines = lines[at] - lines[before + 1]
    last = before.copy()
    for _ in range(2):
        last = np.where(np.isin(codes[last], CLOSERS) & (last > 0), last - 1, last)
    tier = np.full(len(at), 4, np.int64)
    tier[np.isin(codes[last], ENDERS)] = 3
    tier[lines == 1], tier[lines > 1] = 2, 1
    opens = [i for i in np.flatnonzero(lines > 0).tolist() if _SPEECH.match(text, int(at[i]))]
    tier[opens] = 0
    return at, tier


def _characters(text: str, limit: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Every position inside the words, with the blanks behind them, that are too long for any plan that spares them."""
    blank = _blank()[_codes(text)]
    edge = np.unique(np.concatenate([[0], np.flatnonzero(~blank[1:] & blank[:-1]) + 1, [len(blank)]]))
    at = [i for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b - a > limit - 2 * overlap for i in range(a + 1, b)]
    for k, i in enumerate(at):
        j = i
        while j > 1 and i - j < MARKS and unicodedata.combining(text[j]):
            j -= 1
        at[k] = i if unicodedata.combining(text[j]) else j
    at = np.unique(np.array(at, np.int64))
    return at, np.full(len(at), 5, np.int64)


def _starts(codes: np.ndarray, cuts: np.ndarray, overlap: int) -> np.ndarray:
    """Where the piece behind each cut begins."""
    blank = _blank()[codes]
    words = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    earliest = np.maximum(cuts - overlap, 0)
    if not len(words):
        return earliest
    inside = (earliest > 0) & ~blank[earliest] & ~blank[earliest - 1]
    k = np.searchsorted(words, earliest)
    following = np.where(k < len(words), words[np.minimum(k, len(words) - 1)], cuts)
    return np.where(inside & (following < cuts), following, earliest)


def _plan(length: int, cuts: np.ndarray, penalty: np.ndarray, starts: np.ndarray, limit: int, target: float) -> list[int] | None:
    """Numbers of the chosen cuts; None if some piece can't be kept under the limit."""
    ends = np.append(cuts, length)
    pen = np.append(penalty, 0.0)
    begin = np.insert(starts, 0, 0)  # begin[j]: start of the piece behind cut j-1; 0 for the first piece
    # (both ends and begin rise, so the predecessors of an end are a range; the squared cost has monotone minima, so the best one never falls)
    cost = np.full(len(ends) + 1, np.inf)
    cost[0] = 0.0
    back = np.zeros(len(ends) + 1, np.int64)
    low = np.searchsorted(begin, ends - limit)
    for i in range(len(ends)):
        lo, hi = max(low[i], back[i]), i + 1
        if lo >= hi:
            continue
        size = ends[i] - begin[lo:hi]
        c = cost[lo:hi] + ((size - target) / target) ** 2
        c[size <= 0] = np.inf
        j = int(c.argmin())
        cost[i + 1], back[i + 1] = c[j] + pen[i], lo + j
    if not np.isfinite(cost[-1]):
        return None
    path, i = [], back[len(ends)]
    while i > 0:
        path.append(int(i) - 1)
        i = back[i]
    return path[::-1]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of each piece; empty for a text within the limit."""
    n = len(text)
    if n <= limit:
        return []
    codes = _codes(text)
    at, tier = boundaries(text)
    penalties = np.array(list(PENALTY.values()))
    pieces = max(2, int(np.ceil((n - overlap) / (limit - overlap))))
    target = min(limit, (n + (pieces - 1) * overlap) / pieces)
    for worst in (3, 4, 5):
        if worst == 5:
            more, kinds = _characters(text, limit, overlap)
            new = ~np.isin(more, at)
            order = np.argsort(np.concatenate([at, more[new]]), kind="stable")
            at, tier = np.concatenate([at, more[new]])[order], np.concatenate([tier, kinds[new]])[order]
        use = tier <= worst
        cuts = at[use]
        starts = np.maximum.accumulate(_starts(codes, cuts, overlap)) if len(cuts) else cuts
        path = _plan(n, cuts, penalties[tier[use]], starts, limit, target)
        if path is not None:
            begin = [0, *(int(starts[k]) for k in path)]
            return list(zip(begin, [*(int(cuts[k]) for k in path), n], strict=True))
    step = limit - overlap  # pieces hardly longer than the overlap: nothing but plain cuts is left
    return [(a, min(n, a + limit)) for a in range(0, max(1, n - overlap), step)]


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece_no, start_char, end_char, text): pieces of every text above the limit; starts count from 0."""
    long = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.char_length("text") > limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, no, a, b, out = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, (s, e) in enumerate(split_text(text, limit, overlap), 1):
                    ids.append(doc), no.append(k), a.append(s), b.append(e), out.append(text[s:e])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(no, pa.int32()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "piece_no", "start_char", "end_char", "text"])

    return mapped(long, run, "doc_id bigint, piece_no int, start_char bigint, end_char bigint, text string")


def p2_pieces(spark, d: str) -> DataFrame:
    from castgraph.sources import table

    return pieces(table(spark, d, "documents"))


def p2_found(spark, d: str) -> DataFrame:
    return p2_pieces(spark, d).filter("piece_no = 1").select("doc_id")


QUERIES = {"p2_found": p2_found, "p2_pieces": p2_pieces}
SQL = {"p2_found": "SELECT doc_id FROM documents WHERE length(text) > 3000"}
