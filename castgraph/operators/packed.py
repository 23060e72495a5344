"""Several values packed in one field: one row per value, with its place.

The dialect of a field (which delimiters, which quoting) is chosen by minimum description length.  Each distinct field is
parsed under every dialect whose delimiter and quote occur in it; the length of a parse, in bits, is

    dialect + the characters outside its values + ESCAPE per leftover mark + sum of its values' codes

A character outside the values costs one bit under a single delimiter, under a mixed dialect the log2 of the delimiters it may be.
A leftover mark is a delimiter or quote at the edge of a value, or a reference mark inside it.  A value has the shorter of two
codes: spelled out character by character, or its entry in the dictionary of all values of the table.  An entry used by n fields
costs -log2 of its share of all uses, plus its spelling once, spread over the n: what occurs once is never cheaper as an entry.
What a value looks like plays no part in the choice; ``pattern`` only says afterwards which values are wanted.

The dictionary is counted over all distinct fields, distributed, in two rounds: over the values of all parses, then over those
of the parses that the first dictionary makes the cheapest.  Counting distinct fields keeps a field that was delivered often from
passing as one value.  A dictionary of at most BROADCAST entries goes to the tasks (16 bytes an entry), a larger one meets the
values in a shuffled join.

Scale.  All fields of an Arrow batch are parsed together, as arrays of character classes; only fields with quotes are parsed one
by one under the dialects that quote.  The parses' code tables are checkpointed.  Values are counted by their 64-bit hashes, map-side first; a collision
only shifts a code length.  Rows meet the parse of their field by its 128-bit hash, in an inner join whose hot keys
(one field in a third of all rows) Spark's skew handling splits.

Defined results: null and blank fields give no rows, nor do placeholders (none of their values matches the pattern);
delimiters with nothing between them take no place; repeats are kept; equal lengths go to the simpler dialect; rows
are told apart by the id column, which must be unique; input columns other than those named are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.functions import checkpointed, mapped
from castgraph.functions.hashing import mix, substring_hashes

#: Characters with a role in packed fields. Fixed values.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0 " + "".join(map(chr, range(0x2000, 0x200B))) + "    　"
MARKS = {"comma": ",", "semicolon": ";", "pipe": "|", "slash": "/", "ampersand": "&", "dot": "\xb7", "wide comma": "，", "wide semicolon": "；", "ideographic comma": "、"}
QUOTES = "\"'"
#: A cast id: a name without separators of the list kind, an underscore, the play's code.
CAST_ID = r"^(?=[^\x{22}]*(?:\x{22}[^\x{22}]*\x{22}[^\x{22}]*)*$)[\p{L}\p{N}][^_#;|/&\x{b7}\x{ff0c}\x{ff1b}\x{3001}\r\n\t\[\]{}\\]*_[A-Z][a-z]{3}$"

BASE, CHAR, ESCAPE = 2.0, 6.0, 32.0
NAME, MIXED, ANY_QUOTE, DOUBLE_QUOTE = 4.0, 2.0, 2.0, 1.0
BROADCAST = 2_000_000  # entries of a dictionary that is sent to all tasks: 32 MB
CLASSES = {"line": "\r\n", **MARKS, "blank": BLANKS}
BIT = {k: 1 << i for i, k in enumerate(CLASSES)}
MARK_BITS = sum(BIT[k] for k in MARKS)


@dataclass(frozen=True)
class Dialect:
    """mask: its delimiters' bits; bits: length of the dialect's name; per: of each character outside the values."""

    mask: int
    quotes: str
    bits: float
    per: float

    def occurs(self, present: np.ndarray, double: np.ndarray, single: np.ndarray) -> np.ndarray:
        """Fields that this dialect parses in a way of its own; present: bits of the classes that occur in each."""
        if self.mask == BIT["line"]:  # also the parse without any delimiter
            out = np.ones(len(present), bool)
        elif self.mask & (self.mask - 1) == 0:
            out = (present & self.mask) > 0
        elif self.mask & BIT["line"]:  # mixed dialects differ from the single ones only where two kinds occur
            here = present & self.mask
            out = (here & (here - 1)) > 0
        else:
            out = ((present & MARK_BITS) > 0) & ((present & BIT["blank"]) > 0)
        return out & (single if "'" in self.quotes else double if self.quotes else True)


def dialects() -> list[Dialect]:
    """The first is a JSON list."""
    made = [Dialect(0, "", NAME, 1.0)]
    for mask in [*BIT.values(), BIT["line"] | MARK_BITS, BIT["blank"] | MARK_BITS]:
        single = mask & (mask - 1) == 0
        for quotes, more in (("", 0.0), ('"', DOUBLE_QUOTE), ("\"'", ANY_QUOTE)):
            made.append(Dialect(mask, quotes, (NAME if single else NAME + MIXED) + more, 1.0 if single else float(np.log2(sum(len(c) for k, c in CLASSES.items() if mask & BIT[k])))))
    return made


DIALECTS = dialects()


@lru_cache(1)
def _roles() -> np.ndarray:
    """The classes' bits of each code point."""
    out = np.zeros(0x110000, np.uint16)
    for k, chars in CLASSES.items():
        out[[ord(c) for c in chars]] |= BIT[k]
    return out


@lru_cache(64)
def _pattern(mask: int, quotes: str) -> re.Pattern:
    delimiters = "".join(re.escape(c) for k, chars in CLASSES.items() if mask & BIT[k] for c in chars)
    blanks = "".join(re.escape(c) for c in BLANKS)
    quoted = "".join(rf"[{blanks}]*#?{q}(?:[^{q}\\]|{q}{q}|\\.)*{q}(?=[{blanks}]*(?:[{delimiters}]|\Z))|" for q in quotes)
    return re.compile(rf"{quoted}[^{delimiters}]+", re.DOTALL)


_BEFORE = BLANKS + "#"


def _unmark(t: str) -> str:
    return t.lstrip(_BEFORE).rstrip(BLANKS)


def _bare(field: str) -> tuple[str, list[str] | None]:
    """The field without list brackets, and the values if it is a JSON list."""
    body = field.strip(BLANKS)
    if not body.startswith("["):
        return field, None
    values = None
    try:
        values = [_unmark(v if isinstance(v, str) else json.dumps(v)) for v in json.loads(body) if v is not None]
    except ValueError:
        pass
    return (body[1:-1] if body.endswith("]") and len(body) > 1 else field), values and [v for v in values if v]


def _unquote(t: str, q: str, escaped: re.Pattern) -> str:
    if len(t) < 2 or t[0] != q or t[-1] != q:
        return t
    inside = t[1:-1]
    return _unmark(escaped.sub(r"\1\2", inside) if q in inside or "\\" in inside else inside)


_ESCAPED = {q: re.compile(rf"{q}({q})|\\({q}|\\)") for q in QUOTES}


def _values_of(bare: str, d: Dialect) -> list[str]:
    out = [t for t in map(_unmark, _pattern(d.mask, d.quotes).findall(bare)) if t]
    for q in d.quotes:
        escaped = _ESCAPED[q]
        out = [_unquote(t, q, escaped) for t in out]
    return [t for t in out if t]


def parse(field: str, nr: int) -> list[str]:
    """The values of a field in a dialect: without reference marks, outer quotes and outer blanks, escapes undone."""
    bare, listed = _bare(field)
    return _values_of(bare, DIALECTS[nr]) if nr else listed or []


def _hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return substring_hashes(codes, starts, ends).view(np.int64)


def _joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts with a zero behind each; starts and ends."""
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    return codes, np.concatenate([[0], ends[:-1] + 1]) if len(texts) else ends, ends


@lru_cache(1)
def _edge_marks() -> np.ndarray:
    out = np.zeros(0x110000, np.int8)
    out[[ord(c) for c in "".join(MARKS.values()) + QUOTES]] = 1
    return out


def _marks(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Marks that values still have: delimiters and quotes at their edges, reference marks anywhere."""
    edge = _edge_marks()
    inside = np.concatenate([[0], np.cumsum(codes == ord("#"))])
    return edge[codes[starts]] + np.where(ends - starts > 1, edge[codes[ends - 1]], 0) + inside[ends] - inside[starts]


def rivals(fields: list[str]) -> tuple[np.ndarray, ...]:
    """The different parses of each field, and the values of each parse.

    Of parses: field, dialect, fixed bits, those that no dictionary changes.  Of each parse's values: number of the parse, hash, spelled bits.
    """
    bare, listed = zip(*map(_bare, fields), strict=True) if fields else ((), ())
    codes, starts, ends = _joined(list(bare))
    roles = _roles()[codes]
    present = np.bitwise_or.reduceat(np.append(roles, 0), np.minimum(starts, len(roles))).astype(np.int64) if fields else np.zeros(0, np.int64)
    counts = lambda c: np.diff(np.concatenate([[0], np.cumsum(codes == ord(c))])[np.append(starts, len(codes))]) > 0
    double, single = counts('"'), counts("'")
    gap = np.zeros(len(codes) + 1, bool)
    gap[ends], gap[-1] = True, True
    at = np.arange(len(codes) + 1)
    blank = np.append((roles & BIT["blank"]) > 0, False)
    skip = blank | np.append(codes == ord("#"), False)
    first = np.minimum.accumulate(np.where(skip, len(codes), at)[::-1])[::-1]  # the next character that is no blank or mark
    last = np.maximum.accumulate(np.where(blank, -1, at))
    owners, numbers = [], []  # of parses
    v_owner, v_nr, v_start, v_end = [], [], [], []
    texts, t_owner, t_nr = [], [], []
    for nr, d in enumerate(DIALECTS):
        mine = np.flatnonzero(d.occurs(present, double, single)) if nr else np.array([k for k, v in enumerate(listed) if v is not None], np.int64)
        owners.append(mine), numbers.append(np.full(len(mine), nr))
        if nr and not d.quotes and len(mine):
            cut = np.append((roles & d.mask) > 0, False) | gap
            word = np.concatenate([[True], cut])
            edge = np.flatnonzero(word[1:] != word[:-1])
            a, b = edge[::2], edge[1::2]
            wanted = np.zeros(len(fields), bool)
            wanted[mine] = True
            owner = np.searchsorted(ends, a)
            use = wanted[owner]
            a, b, owner = first[a[use]], last[b[use] - 1] + 1, owner[use]
            full = a < b
            v_owner.append(owner[full]), v_nr.append(np.full(int(full.sum()), nr)), v_start.append(a[full]), v_end.append(b[full])
        else:
            for k in mine.tolist():
                values = _values_of(bare[k], d) if nr else listed[k]
                texts += values
                t_owner += [k] * len(values)
                t_nr += [nr] * len(values)
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    more, m_start, m_end = _joined(texts)
    a, b, c, e = cat(v_start), cat(v_end), m_start.astype(np.int64), m_end.astype(np.int64)
    value = np.concatenate([_hashes(codes, a, b), _hashes(more, c, e)])
    size = np.concatenate([b - a, e - c])
    left = np.concatenate([_marks(codes, a, b), _marks(more, c, e)])
    owner, number = cat(owners), cat(numbers)
    key = owner * len(DIALECTS) + number
    order = np.argsort(key, kind="stable")
    key, owner, number = key[order], owner[order], number[order]
    v_key = np.concatenate([cat(v_owner), np.array(t_owner, np.int64)]) * len(DIALECTS) + np.concatenate([cat(v_nr), np.array(t_nr, np.int64)])
    order = np.argsort(v_key, kind="stable")
    v_parse, value, size, left = np.searchsorted(key, v_key[order]), value[order], size[order], left[order]
    n = np.bincount(v_parse, minlength=len(key))
    place = np.arange(len(v_parse)) - np.repeat(np.cumsum(n) - n, n)
    with np.errstate(over="ignore"):  # what a parse is: its values in their order
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value.view(np.uint64) + mix(place.astype(np.uint64) + np.uint64(1))))])
    stops = np.concatenate([[0], np.cumsum(n)])
    bits, per = np.array([d.bits for d in DIALECTS]), np.array([d.per for d in DIALECTS])
    outside = np.fromiter(map(len, fields), np.int64, len(fields))[owner] - np.bincount(v_parse, size, len(key))
    fixed = bits[number] + np.maximum(outside, 0) * per[number] + np.bincount(v_parse, left, len(key)) * ESCAPE
    # of equal parses of a field the one in the shortest dialect stays
    with np.errstate(over="ignore"):
        parsed = sums[stops[1:]] - sums[stops[:-1]]
    order = np.lexsort((number, fixed, parsed, owner))
    keep = np.ones(len(order), bool)
    keep[1:] = (owner[order][1:] != owner[order][:-1]) | (parsed[order][1:] != parsed[order][:-1])
    chosen = np.sort(order[keep])
    renumbered = np.full(len(key), -1, np.int64)
    renumbered[chosen] = np.arange(len(chosen))
    v_parse = renumbered[v_parse]
    stays = v_parse >= 0
    return owner[chosen], number[chosen], fixed[chosen], v_parse[stays], value[stays], BASE + CHAR * size[stays]


# -- Spark -----------------------------------------------------------------------------------------------------------


def _lists(of: np.ndarray, n: int, values: pa.Array) -> pa.ListArray:
    """values, sorted by the row they belong to, as lists of n rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(n + 1)).astype(np.int32)), values)


def _parse_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fields = batch.column(2).to_pylist()
        owner, number, fixed, of, value, spelled = rivals(fields)
        within = np.arange(len(owner)) - np.searchsorted(owner, owner)
        field = owner[of]
        columns = [_lists(owner, len(fields), pa.array(number.astype(np.int32))), _lists(owner, len(fields), pa.array(fixed)), _lists(field, len(fields), pa.array(within[of].astype(np.int32))), _lists(field, len(fields), pa.array(value)), _lists(field, len(fields), pa.array(spelled))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=["h1", "h2", "field", "nr", "fixed", "at", "value", "spelled"])


class Dictionary:
    """Values used by two fields and more: hashes, their uses, and the sum of all uses."""

    def __init__(self, counts: DataFrame):
        self.counts = checkpointed(counts.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        row = self.counts.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k")).first()
        self.total, self.entries = float(row["total"] or 1), row["k"]

    def cheapest(self, base: DataFrame) -> DataFrame:
        """Adds ``i``, the place of each field's cheapest parse; equal lengths: the simpler dialect."""
        return self._sent(base) if self.entries <= BROADCAST else self._joined(base)

    def _sent(self, base: DataFrame) -> DataFrame:
        table = self.counts.toArrow()
        values, uses = (table.column(c).to_numpy() for c in ("value", "n"))
        order = np.argsort(values)
        total = self.total
        shared = base.sparkSession.sparkContext.broadcast((values[order], uses[order].astype(np.float64)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, uses = shared.value
            for batch in batches:
                number, fixed, at, value, spelled = (batch.column(c) for c in ("nr", "fixed", "at", "value", "spelled"))
                n = number.value_lengths().to_numpy(zero_copy_only=False)
                start = np.cumsum(n) - n
                bits, value = (c.flatten().to_numpy(zero_copy_only=False) for c in (spelled, value))
                if len(known):
                    k = np.minimum(np.searchsorted(known, value), len(known) - 1)
                    bits = np.where(known[k] == value, np.minimum(bits, np.log2(total) - np.log2(uses[k]) + bits / uses[k]), bits)
                parse = np.repeat(start, at.value_lengths().to_numpy(zero_copy_only=False)) + at.flatten().to_numpy(zero_copy_only=False)
                fixed, number = (c.flatten().to_numpy(zero_copy_only=False) for c in (fixed, number))
                length = fixed + np.bincount(parse, bits, len(fixed))
                owner = np.repeat(np.arange(len(n)), n)
                order = np.lexsort((number, fixed, np.round(length, 6), owner))
                best = order[start]  # sorted by field: the first of each (every field has the parse without delimiters)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((best - start).astype(np.int32))], names=[*batch.schema.names, "i"])

        return mapped(base, run, base.select("*", F.lit(0).alias("i")).schema)

    def _joined(self, base: DataFrame) -> DataFrame:
        codes = F.explode_outer(F.arrays_zip("at", "value", "spelled"))
        each = base.select("h1", "h2", codes.alias("c")).select("h1", "h2", "c.*").join(self.counts, "value", "left")
        bits = F.least("spelled", F.coalesce(F.lit(float(np.log2(self.total))) - F.log2("n") + F.col("spelled") / F.col("n"), F.col("spelled")))
        sums = each.filter("at IS NOT NULL").groupBy("h1", "h2", "at").agg(F.sum(bits).alias("bits")).groupBy("h1", "h2").agg(F.map_from_entries(F.collect_list(F.struct("at", "bits"))).alias("sums"))
        ranked = F.transform("nr", lambda x, i: F.struct(F.round(F.get("fixed", i) + F.coalesce(F.col("sums")[i], F.lit(0.0)), 6).alias("length"), F.get("fixed", i).alias("fixed"), x.alias("nr"), i.alias("i")))
        return base.join(sums, ["h1", "h2"], "left").withColumn("i", F.array_min(ranked)["i"]).select(*base.columns, "i")


def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = [parse(f, n) for f, n in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values, pa.list_(pa.string()))], names=["h1", "h2", "values"])


def split_packed(df: DataFrame, id_col: str, field: str, keep: tuple[str, ...] = (), pattern: str = CAST_ID, value: str = "value") -> DataFrame:
    """(id, keep..., pos, value): one row per value of the field in its cheapest dialect that matches the pattern."""
    keys = [F.xxhash64("field").alias("h1"), F.xxhash64(F.lit(1), "field").alias("h2")]
    rows = df.select(F.struct(F.col(id_col).alias("id"), *(F.col(c).alias(f"k{i}") for i, c in enumerate(keep))).alias("row"), F.col(field).alias("field"))
    rows = rows.filter(F.btrim("field", F.lit(BLANKS)) != "")
    fields = rows.select("field").distinct().select(*keys, "field")
    schema = "h1 bigint, h2 bigint, field string, nr array<int>, fixed array<double>, at array<int>, value array<bigint>, spelled array<double>"
    base = checkpointed(mapped(fields, _parse_batches, schema))  # read four times
    first = Dictionary(base.select(F.explode(F.array_distinct("value")).alias("value")))
    mine = F.filter(F.arrays_zip("at", "value"), lambda c: c["at"] == F.col("i"))
    second = Dictionary(first.cheapest(base).select(F.explode(F.array_distinct(F.transform(mine, lambda c: c["value"]))).alias("value")))
    won = mapped(second.cheapest(base).select("h1", "h2", "field", F.get("nr", F.col("i")).alias("nr")), _values, "h1 bigint, h2 bigint, values array<string>")
    wanted = won.withColumn("values", F.filter("values", lambda v: F.rlike(v, F.lit(pattern)))).filter(F.size("values") > 0)
    named = [F.col("row.id").alias(id_col), *(F.col(f"row.k{i}").alias(c) for i, c in enumerate(keep))]
    met = rows.select("row", *keys).join(wanted, ["h1", "h2"])
    return met.select(*named, F.posexplode("values").alias("pos", value)).withColumn("pos", (F.col("pos") + 1).cast("int"))
