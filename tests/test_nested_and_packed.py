"""Problems 3 and 5: edge cases and brute force."""

import json

from pyspark.sql import functions as F

from castgraph.operators.nested import flatten_plays, union_levels
from castgraph.operators.packed import split_packed
from castgraph.plans.problems import QUERIES

SP = {"who": ["#A_Bcde", {"ref": "#B C_Bcde"}, "", None], "speaker": {"label": "L"}}
BODIES = [
    '﻿ <?xml version="1.0"?><t:TEI xmlns:t="u"><t:text><t:body><t:div1/><t:div1><t:sp who=" #A_Bcde&#10;#A_Bcde"><t:speaker>X &amp; Y</t:speaker></t:sp><t:div2><!-- <sp/> --><t:sp/><t:div3><t:sp who=" "/></t:div3></t:div2></t:div1></t:body></t:text></t:TEI>',
    json.dumps({"acts": [{"speeches": [SP], "scenes": [None, {"groups": [{}, {"speeches": [{"who": None}]}]}]}]}),
    json.dumps({"deposit": "v2", "payload": json.dumps({"TEI": {"text": {"body": {"div1": {"sp": {"@who": "#A_Bcde B_Bcde"}}}}}})}),
    "<TEI><text><body><div1><sp",
    "{not json",
    "",
    "  ",
    None,
]


def test_nested_edge_cases(spark):
    df = spark.createDataFrame([(i, b, "x", "y") for i, b in enumerate(BODIES)] + [(0, BODIES[0], "x", "y")], "record_id long, body string, acts string, who string")
    t = flatten_plays(df)
    rows = sorted(tuple(r) for r in t["speakers"].collect())
    doc0 = [(0, 2, 0, 0, 1, 1, "A_Bcde", "X & Y"), (0, 2, 0, 0, 1, 2, "A_Bcde", "X & Y"), (0, 2, 1, 0, 1, 1, "[UNKNOWN]", None), (0, 2, 1, 1, 1, 1, "[UNKNOWN]", None)]
    assert sorted(r for r in rows if r[0] == 0) == sorted(doc0 * 2)
    assert [r[1:-1] for r in rows if r[0] == 1] == [(1, 0, 0, 1, 1, "A_Bcde"), (1, 0, 0, 1, 2, "B C_Bcde"), (1, 2, 2, 1, 1, "[UNKNOWN]")]
    assert [r[6] for r in rows if r[0] == 2] == ["A_Bcde", "B_Bcde"]
    assert not [r for r in rows if r[0] > 2]
    assert t["acts"].filter("record_id = 0").count() == 4 and t["scenes"].filter("record_id = 1").count() == 2
    assert {r.level for r in union_levels(t).collect()} == {"acts", "scenes", "groups", "speeches", "speakers"}
    assert flatten_plays(df.limit(0))["speakers"].count() == 0


FIELDS = {
    "#A_Bcde #B_Bcde": ["A_Bcde", "B_Bcde"],
    "#A_Bcde,,#B-C_Bcde": ["A_Bcde", "B-C_Bcde"],
    '"#B, a cook_Bcde","#A_Bcde"': ["B, a cook_Bcde", "A_Bcde"],
    "#B, a cook_Bcde | #Old A_Bcde": ["B, a cook_Bcde", "Old A_Bcde"],
    '["#\\u00d6l \\"the Moth\\"_Bcde", "#A_Bcde", "#A_Bcde"]': ['Öl "the Moth"_Bcde', "A_Bcde", "A_Bcde"],
    "'#A_Bcde'; \"#O'Neil_Bcde\"": ["A_Bcde", "O'Neil_Bcde"],
    '"#W ""the Nail""_Bcde"；#A_Bcde': ['W "the Nail"_Bcde', "A_Bcde"],
    "A_Bcde\r\n#B-C_Bcde ": ["A_Bcde", "B-C_Bcde"],
    ' ;#A_Bcde & "#Old B_Bcde",C_Bcde|': ["A_Bcde", "Old B_Bcde", "C_Bcde"],
    "-": [],
    "[]": [],
    "  \t": [],
    "": [],
}


def test_packed_dialects(spark):
    many = " | ".join(f"#N{i}, heir of X_Bcde" for i in range(3000))
    cases = list(FIELDS.items()) + [(None, []), (many, [f"N{i}, heir of X_Bcde" for i in range(3000)])]
    df = spark.createDataFrame([(i, f, "p", 1) for i, (f, _) in enumerate(cases)], "row_id long, onstage string, values string, pos int")
    out = split_packed(df, "row_id", "onstage", ("values",), value="node")
    assert out.columns == ["row_id", "values", "pos", "node"]
    got = {}
    for r in out.orderBy("row_id", "pos").collect():
        got.setdefault(r.row_id, []).append(r.node)
        assert r.pos == len(got[r.row_id])
    for i, (field, want) in enumerate(cases):
        assert got.get(i, []) == want, field
    assert split_packed(df.limit(0), "row_id", "onstage").count() == 0


def test_queries_run(spark, small):
    import duckdb

    from castgraph.plans.problems import SQL

    duckdb.sql(f"CREATE OR REPLACE VIEW hyperedges AS SELECT * FROM '{small}/hyperedges.parquet'")
    want = {tuple(r) for r in duckdb.sql(SQL["p5_found"]).fetchall()}
    assert {tuple(r) for r in QUERIES["p5_found"](spark, small).collect()} == want
    assert QUERIES["p3_found"](spark, small).count() > 0
    for name in ("acts", "scenes", "groups", "speeches", "speakers"):
        assert QUERIES[f"p3_{name}"](spark, small).select(F.count("record_id")).first()[0] > 0
