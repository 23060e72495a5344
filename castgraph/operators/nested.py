"""Deeply nested play records (TEI XML or JSON of several shapes) as flat, linked tables.

Every body is first brought to one common nested shape, ``acts``:

    array<struct<n, speeches: array<struct<who: array<string>, label>>,
                 scenes: array<struct<n, speeches, groups: array<struct<n, speeches>>>>>>

XML goes through ``from_xml`` (a real parser: comments, CDATA and entities are no elements), JSON through
``try_parse_json`` and variant paths, where a single element may stand without its array.  The five target
tables are then pure projections of that column: nested ``transform`` calls attach the ancestors' keys and the
1-based places, ``flatten`` joins the levels, one ``inline`` per table emits the rows.  There is no shuffle and
no Python: each record is handled where it is read.

Defined results: a null, empty, blank or unparsable body gives no rows; a missing level gives no rows of that
level; a null array element keeps its place and is empty; records with equal ids or equal bodies are each listed;
columns of the input other than the two named ones are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph.functions import once

UNKNOWN = "[UNKNOWN]"

_SP = "array<struct<_who:string,speaker:string>>"
_GROUP = f"array<struct<_n:string,sp:{_SP}>>"
_SCENE = f"array<struct<_n:string,sp:{_SP},div3:{_GROUP}>>"
_ACT = f"array<struct<_n:string,sp:{_SP},div2:{_SCENE}>>"
XML_SCHEMA = f"struct<text:struct<body:struct<div1:{_ACT}>>>"

#: Names of one meaning in the JSON shapes.
LEVELS = {"act": ("acts", "div1"), "scene": ("scenes", "div2"), "group": ("groups", "div3"), "speech": ("speeches", "sp")}
ROOTS = ("$", "$.TEI.text.body", "$.text.body", "$.body")

_SPEECH_T = "struct<who:array<string>,label:string>"
_GROUP_T = f"struct<n:string,speeches:array<{_SPEECH_T}>>"
_SCENE_T = f"struct<n:string,speeches:array<{_SPEECH_T}>,groups:array<{_GROUP_T}>>"
ACTS_T = f"array<struct<n:string,speeches:array<{_SPEECH_T}>,scenes:array<{_SCENE_T}>>>"


def _or_empty(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array().cast(kind))


def _ids(text: Column) -> Column:
    """The ids of a who value without their mark: parts between blanks; ids that end in a play's code may hold blanks themselves."""
    blank = r"[\s\x{85}\p{Z}]+"
    parts = F.when(F.rlike(text, F.lit(rf"_[A-Z][a-z]{{3}}({blank}|$)")), F.split(text, rf"(?<=_[A-Z][a-z]{{3}}){blank}|{blank}(?=#)")).otherwise(F.split(text, blank))
    bare = F.transform(parts, lambda x: F.regexp_replace(x, rf"^{blank}|{blank}$|^{blank[:-1]}*#+", ""))
    return F.filter(bare, lambda x: x != "")


# -- XML ----------------------------------------------------------------------------------------------------


def _xml_speeches(level: Column) -> Column:
    made = F.transform(level["sp"], lambda s: F.struct(_or_empty(_ids(s["_who"]), "array<string>").alias("who"), s["speaker"].alias("label")))
    return _or_empty(made, f"array<{_SPEECH_T}>").alias("speeches")


def _xml_acts(body: Column) -> Column:
    x = F.from_xml(body, XML_SCHEMA, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    group = lambda g: F.struct(g["_n"].alias("n"), _xml_speeches(g))
    scene = lambda s: F.struct(s["_n"].alias("n"), _xml_speeches(s), _or_empty(F.transform(s["div3"], group), f"array<{_GROUP_T}>").alias("groups"))
    act = lambda a: F.struct(a["_n"].alias("n"), _xml_speeches(a), _or_empty(F.transform(a["div2"], scene), f"array<{_SCENE_T}>").alias("scenes"))
    return F.transform(x["text"]["body"]["div1"], act)


# -- JSON ---------------------------------------------------------------------------------------------------


def _at(v: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(v, path, kind)


def _is_string(v: Column) -> Column:
    return F.schema_of_variant(v) == "STRING"


def _many(v: Column, names: tuple[str, ...]) -> Column:
    """An array of variants, be it stored as an array or as its only element; null if absent."""

    def one(name: str) -> Column:
        path = f"$.{name}"
        single = _at(v, path)
        return F.coalesce(_at(v, path, "array<variant>"), F.when(single.isNotNull() & ~F.is_variant_null(single), F.array(single)))

    return F.coalesce(*map(one, names))


def _text(v: Column, *paths: str) -> Column:
    return F.coalesce(*(F.when(_is_string(_at(v, p)), _at(v, p, "string")) for p in paths))


def _json_who(sp: Column) -> Column:
    def ref(e: Column) -> Column:
        return _ids(F.coalesce(F.when(_is_string(e), F.try_variant_get(e, "$", "string")), _text(e, "$.ref", "$['@ref']")))

    def one(path: str) -> Column:
        v = _at(sp, path)
        some = F.coalesce(_at(sp, path, "array<variant>"), F.when(v.isNotNull() & ~F.is_variant_null(v), F.array(v)))
        return F.flatten(F.filter(F.transform(some, ref), lambda x: x.isNotNull()))

    return _or_empty(F.coalesce(one("$.who"), one("$['@who']")), "array<string>")


def _json_speeches(level: Column) -> Column:
    made = F.transform(_many(level, LEVELS["speech"]), lambda s: F.struct(_json_who(s).alias("who"), _text(s, "$.speaker", "$.speaker.label", "$.speaker['#text']").alias("label")))
    return _or_empty(made, f"array<{_SPEECH_T}>").alias("speeches")


def _json_acts(v: Column) -> Column:
    n = lambda x: F.coalesce(_at(x, "$.n", "string"), _at(x, "$['@n']", "string")).alias("n")
    group = lambda g: F.struct(n(g), _json_speeches(g))
    scene = lambda s: F.struct(n(s), _json_speeches(s), _or_empty(F.transform(_many(s, LEVELS["group"]), group), f"array<{_GROUP_T}>").alias("groups"))
    act = lambda a: F.struct(n(a), _json_speeches(a), _or_empty(F.transform(_many(a, LEVELS["scene"]), scene), f"array<{_SCENE_T}>").alias("scenes"))
    return F.transform(F.coalesce(*(_many(v if root == "$" else _at(v, root), LEVELS["act"]) for root in ROOTS)), act)


# -- the common shape and the tables --------------------------------------------------------------------------


def unwrapped(records: DataFrame, id_col: str, body_col: str) -> DataFrame:
    """(record_id, body) without byte-order mark and blanks in front; a JSON envelope's string ``payload`` is unpacked."""
    blank = r"^[\s\x{feff}]+"
    df = records.select(F.col(id_col).alias("record_id"), F.regexp_replace(F.col(body_col), blank, "").alias("body"))
    df = once(df, "envelope", F.when(F.substring("body", 1, 1) == "{", F.try_parse_json("body")))
    return once(df, "body", F.coalesce(F.regexp_replace(_text(F.col("envelope"), "$.payload"), blank, ""), F.col("body"))).select("record_id", "body")


def with_acts(records: DataFrame, id_col: str = "record_id", body_col: str = "body") -> DataFrame:
    """(record_id, acts) of each record, unwrapped first."""
    df = unwrapped(records, id_col, body_col)
    df = once(df, "v", F.when(F.substring("body", 1, 1).isin("{", "["), F.try_parse_json("body")))
    acts = F.when(F.substring("body", 1, 1) == "<", _xml_acts(F.col("body"))).otherwise(_json_acts(F.col("v")))
    return once(df, "acts", _or_empty(acts, ACTS_T).cast(ACTS_T)).select("record_id", "acts")


def _key(*numbers: Column | int) -> list[Column]:
    return [(F.lit(x) if isinstance(x, int) else x).cast("int").alias(name) for x, name in zip(numbers, ("act_no", "scene_no", "group_no"), strict=False)]


def _speech_rows(speeches: Column, key: list[Column]) -> Column:
    return F.transform(speeches, lambda s, i: F.struct(*key, (i + 1).cast("int").alias("speech_no"), s["label"].alias("label"), s["who"].alias("who")))


def _all_speeches(acts: Column) -> Column:
    def of_scene(s: Column, a: Column, j: Column) -> Column:
        inner = F.transform(s["groups"], lambda g, k: _speech_rows(g["speeches"], _key(a + 1, j + 1, k + 1)))
        return F.concat(_speech_rows(s["speeches"], _key(a + 1, j + 1, 0)), F.flatten(inner))

    def of_act(a: Column, i: Column) -> Column:
        return F.concat(_speech_rows(a["speeches"], _key(i + 1, 0, 0)), F.flatten(F.transform(a["scenes"], lambda s, j: of_scene(s, i, j))))

    return F.flatten(F.transform(acts, of_act))


def flatten_plays(records: DataFrame, id_col: str = "record_id", body_col: str = "body") -> dict[str, DataFrame]:
    """Tables ``acts``, ``scenes``, ``groups``, ``speeches``, ``speakers``; the leading key columns link each row to its parent.

    A speech directly in an act has scene_no 0 and group_no 0, one directly in a scene group_no 0.  A speech
    without who gives one speaker row, ``[UNKNOWN]``; repeated who values are kept.
    """
    df = with_acts(records, id_col, body_col)
    acts = F.col("acts")
    act_rows = F.transform(acts, lambda a, i: F.struct(*_key(i + 1), a["n"].alias("n")))
    scene_rows = F.flatten(F.transform(acts, lambda a, i: F.transform(a["scenes"], lambda s, j: F.struct(*_key(i + 1, j + 1), s["n"].alias("n")))))
    group_rows = F.flatten(F.transform(acts, lambda a, i: F.flatten(F.transform(a["scenes"], lambda s, j: F.transform(s["groups"], lambda g, k: F.struct(*_key(i + 1, j + 1, k + 1), g["n"].alias("n")))))))

    def emit(rows: Column, drop: tuple[str, ...] = ()) -> DataFrame:
        return df.select("record_id", F.inline(rows)).drop(*drop)

    def speakers(s: Column) -> Column:
        who = F.when(F.size(s["who"]) > 0, s["who"]).otherwise(F.array(F.lit(UNKNOWN)))
        return F.transform(who, lambda w, i: F.struct(*(s[c].alias(c) for c in ("act_no", "scene_no", "group_no", "speech_no")), (i + 1).cast("int").alias("who_no"), w.alias("who"), s["label"].alias("label")))

    speeches = _all_speeches(acts)
    return {
        "acts": emit(act_rows),
        "scenes": emit(scene_rows),
        "groups": emit(group_rows),
        "speeches": emit(speeches, ("who",)),
        "speakers": emit(F.flatten(F.transform(speeches, speakers))),
    }


def union_levels(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of every table by record and level (a report)."""
    counted = [df.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_rows")).select("record_id", F.lit(name).alias("level"), "n_rows") for name, df in sorted(tables.items())]
    return reduce(DataFrame.unionByName, counted)
