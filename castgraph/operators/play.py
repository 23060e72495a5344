"""Plays: TEI tags, speeches and adjacent-speech metrics: O-05, O-06, O-21..O-23, O-45..O-47, O-69.

TEI texts are parsed in Arrow batches by an XML parser, so comments, CDATA, prefixes and nested elements of one name are what they are.
A text that is no XML (null, JSON, malformed) gives no rows.  Speeches outside ``div2`` or not directly in one are ignored; a
speech without who has the speaker [UNKNOWN].
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from castgraph.functions import mapped
from castgraph.operators.nested import unwrapped
from castgraph.operators.vectors import cosine

UNKNOWN = "[UNKNOWN]"
XML_ID = "{http://www.w3.org/XML/1998/namespace}id"


def _parsed(df: DataFrame, play: str, text: str, rows_of: Callable[[str], list[tuple]], columns: str) -> DataFrame:
    """(play, columns...): the rows of each play's text."""
    bodies = unwrapped(df, play, text).withColumnRenamed("record_id", "play").filter("startswith(body, '<')")
    schema = bodies.select("play").sparkSession.createDataFrame([], f"play {bodies.schema['play'].dataType.simpleString()}, {columns}").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, body in zip(batch.column(0), batch.column(1), strict=True):
                try:
                    rows = rows_of(body.as_py())
                except (expat.ExpatError, ElementTree.ParseError):
                    continue
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(rows), arrow[0].type), *(pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(arrow)[1:], strict=True))], schema=arrow)

    return mapped(bodies, run, schema)


def elements(xml: str, tag: str) -> list[str]:
    """The source text of every element of a name (prefixes aside), nested ones too, in document order."""
    raw = xml.encode("utf-8", "surrogatepass")
    found: list[tuple[int, int]] = []
    begun: list[int] = []
    last = None
    parser = expat.ParserCreate("utf-8")

    def start(name: str, _: dict) -> None:
        nonlocal last
        last = name
        if name.rpartition(":")[2] == tag:
            begun.append(parser.CurrentByteIndex)

    def end(name: str) -> None:
        nonlocal last
        if name.rpartition(":")[2] == tag:
            at = parser.CurrentByteIndex
            empty = last == name and raw[at - 2 : at] == b"/>"  # an empty element ends where its only tag does
            found.append((begun.pop(), at if empty else raw.index(b">", at) + 1))
        last = None

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.Parse(raw, True)
    return [raw[a:b].decode("utf-8", "surrogatepass") for a, b in sorted(found)]


def tags(df: DataFrame, play: str, text: str, tag: str) -> DataFrame:
    """(play, idx, xml): every element of a name, in document order."""
    return _parsed(df, play, text, lambda xml: list(enumerate(elements(xml, tag))), "idx int, xml string")


def _name(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _speeches(xml: str) -> list[tuple]:
    out = []
    for i, scene in enumerate(e for e in ElementTree.fromstring(xml).iter() if _name(e) == "div2"):
        for j, sp in enumerate(e for e in scene if _name(e) == "sp"):
            who = (sp.get("who") or "").split()
            ab = next((e for e in sp if _name(e) == "ab"), ())
            out.append((i, j, (who[0].removeprefix("#") if who else "") or UNKNOWN, "".join(e.text or "" for e in ab if isinstance(e.tag, str))))
    return out


def speeches(df: DataFrame, play: str, text: str) -> DataFrame:
    """(play, scene_idx, speech_idx, speaker, text): direct speeches of each div2; the text joins the first ab's children's own texts."""
    return _parsed(df, play, text, _speeches, "scene_idx int, speech_idx int, speaker string, text string")


def _characters(xml: str) -> list[tuple]:
    every = [(_name(e), e.get(XML_ID)) for e in ElementTree.fromstring(xml).iter()]
    return list(enumerate([*(i for n, i in every if n == "person" and i), *(i for n, i in every if n == "personGrp" and i), UNKNOWN]))


def characters(df: DataFrame, play: str, text: str) -> DataFrame:
    """(play, idx, character): ids of person, then personGrp, then [UNKNOWN]."""
    return _parsed(df, play, text, _characters, "idx int, character string")


def with_next(df: DataFrame, scene: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Adds next_<column> of the following speech of the scene."""
    w = Window.partitionBy(*scene).orderBy(*order)
    return df.select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in columns))


def adjacent_cooccurrence(df: DataFrame, scene: list[str], order: list[str], speaker: str = "speaker", group: list[str] | None = None) -> DataFrame:
    """(group..., char1, char2, value): consecutive speeches of different speakers."""
    nxt = F.col(f"next_{speaker}")
    pairs = with_next(df, scene, order, [speaker]).filter(nxt.isNotNull() & (F.col(speaker) != nxt))
    return pairs.groupBy(*(group or []), F.least(F.col(speaker), nxt).alias("char1"), F.greatest(F.col(speaker), nxt).alias("char2")).agg(F.count(F.lit(1)).alias("value"))


def adjacent_cosine_sum(df: DataFrame, scene: list[str], order: list[str], speaker: str = "speaker", vec: str = "vec", include_self: bool = True) -> DataFrame:
    """(char1, char2, value): summed cosine of consecutive speeches; a speaker following themself counts on the diagonal."""
    nxt = F.col(f"next_{speaker}")
    pairs = with_next(df, scene, order, [speaker, vec]).filter(nxt.isNotNull())
    if not include_self:
        pairs = pairs.filter(F.col(speaker) != nxt)
    return pairs.groupBy(F.least(F.col(speaker), nxt).alias("char1"), F.greatest(F.col(speaker), nxt).alias("char2")).agg(F.sum(cosine(F.col(vec), F.col(f"next_{vec}"))).alias("value"))


def directed_pairs(df: DataFrame, scene: list[str], order: list[str], speaker: str = "speaker", text: str = "text") -> DataFrame:
    """One row per consecutive pair of speeches of different speakers: (scene..., char1, char2, text1, text2), in speech order."""
    out = with_next(df, scene, order, [speaker, text]).filter(F.col(f"next_{speaker}").isNotNull() & (F.col(speaker) != F.col(f"next_{speaker}")))
    return out.select(*scene, *order, F.col(speaker).alias("char1"), F.col(f"next_{speaker}").alias("char2"), F.col(text).alias("text1"), F.col(f"next_{text}").alias("text2"))
