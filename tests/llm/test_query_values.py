"""The queries' values on the smallest tables, where no SQL gives them."""

import math
from collections import Counter

from castgraph.llm import queries, severity, tokens
from castgraph.sources import table


def test_pieces_cover_their_texts(spark, small):
    texts = {}
    for r in table(spark, small, "documents").select("doc_id", "text").collect():
        if r.text and len(r.text) > 3000:
            texts.setdefault(r.doc_id, []).append(r.text)
    found = {}
    for r in queries.QUERIES["p2_pieces"](spark, small).collect():
        found.setdefault(r.doc_id, []).append(r)
    assert set(found) == set(texts)
    for doc, rows in found.items():
        (text,) = texts[doc]
        rows.sort(key=lambda r: r.piece_no)
        assert [r.piece_no for r in rows] == list(range(1, len(rows) + 1)) and rows[0].start_char == 0 and rows[-1].end_char == len(text)
        assert all(r.text == text[r.start_char : r.end_char] and len(r.text) <= 3000 for r in rows)
        for a, b in zip(rows, rows[1:], strict=False):
            shared = a.end_char - b.start_char
            assert shared == 200 or (0 <= shared < 200 and not text[b.start_char].isspace() and text[b.start_char - 1].isspace())


def test_ids_of_all_documents(spark, small):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    got = {r.doc_id: list(r.ids) for r in queries.QUERIES["p6_ids"](spark, small).collect()}
    want = {r.doc_id: t.encode(r.text, add_special_tokens=False).ids if r.text else [] for r in table(spark, small, "documents").collect()}
    assert got == want


def test_strings_that_collide_modulo_powers_of_two(spark):
    word = "a"
    for _ in range(12):
        word += word.translate({97: 98, 98: 97})
    other = word.translate({97: 98, 98: 97})
    e = tokens.Encoder(*tokens.load_vocabulary(f"{tokens.TOKENIZERS}/byte_bpe_50k.tiktoken"))
    import pyarrow as pa

    both = e.encode_column(pa.array([word + " " + other])).to_pylist()[0]
    alone = [i for w in (word, " " + other) for i in tokens.merge_bytes(w.encode(), e.ranks)]
    assert both == alone


def test_runs_of_bounded_texts():
    import pyarrow as pa

    assert tokens._bounded(pa.array(["aaa", None, "bb", "c", "dddddd", ""]), 5) == [(0, 2), (2, 4), (4, 6)]
    assert tokens._bounded(pa.array([], pa.string()), 5) == [(0, 0)]


def test_leaked_items_agree(spark, small):
    found = {(r.doc_id, r.item_id) for r in queries.QUERIES["p7_found"](spark, small).collect()}
    near = {(r.doc_id, r.item_id): r.edits for r in queries.QUERIES["p7_near"](spark, small).collect()}
    assert found == {k for k, edits in near.items() if edits == 0}
    assert {r.item_id: r.n_documents for r in queries.QUERIES["p7_items"](spark, small).collect()} == Counter(i for _, i in found)


def test_rates_add_up(spark, small):
    scores = [r.severity for r in queries.QUERIES["p8_scores"](spark, small).collect()]
    rates = queries.QUERIES["p8_rates"](spark, small).collect()
    assert sum(r.n_documents for r in rates) == len(scores) == table(spark, small, "documents").count()
    assert sum(r.n_cases for r in rates) == sum(s >= severity.CASE for s in scores) == queries.QUERIES["p8_found"](spark, small).count()
    assert all(math.isclose(r.rate, r.n_cases / r.n_documents) for r in rates)


def test_terms_of_many_words():
    kinds = severity.term_kinds([("a very bad green old fog", "insult"), ("soup", "hate")])
    assert sorted(n for _, n in kinds.values()) == [1, 6]
    scores = severity.fit([], [], kinds).scores(["a very bad green old fog came", "a very bad green fog came", "soup"])
    assert scores[0] > scores[1] and scores[2] > scores[1]


def test_surprise_of_the_plays(spark, small):
    rows = queries.QUERIES["p4_pairs"](spark, small).collect()
    assert rows and all(0 <= r.p_value <= 1 and r.p_value <= r.q_value + 1e-12 <= 1 + 1e-9 and r.expected >= 0 for r in rows)
    assert all(r["count"] <= min(r.c1, r.c2) <= r.n for r in rows)
