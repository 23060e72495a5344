"""Hand-worked fixtures of the text, entity, co-occurrence and context operators, and a random comparison."""

from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from castgraph.operators import contexts, cooccur, entities, mlmprep, text


def run_cooc(spark, words, lines, window=15):
    tokens = spark.createDataFrame([("b", i, w) for i, w in enumerate(words)], "book string, pos int, token string")
    aliases = entities.alias_rows(spark, lines)
    mentions = entities.mentions(entities.canonicalize(tokens, aliases), aliases)
    return {(r.char1, r.char2): r["count"] for r in cooccur.cooccurrences(mentions, window).collect()}


def test_clean_and_cooccurrence(spark):
    df = spark.createDataFrame([("b", "Harry met Ron. Harry’s owl - Hedwig; the RON!"), ("n", None)], "book string, text string")
    rows = text.token_table(df, "book", "text", ["the"]).orderBy("pos").collect()
    words = [r.token for r in rows]
    assert words == ["harry", "met", "ron", "harrys", "owl", "", "hedwig", "ron"]
    for window, expected in ((15, 2), (8, 2), (7, 1)):
        assert run_cooc(spark, words, ["harry potter", "ron weasley"], window) == {("harry", "ron"): expected}


def test_alias_asymmetry_and_duplicate_canonicals(spark):
    assert run_cooc(spark, "macbeth lady banquo macbeth".split(), ["banquo", "", "macbeth", "lady macbeth"]) == {("banquo", "lady"): 3}
    got = run_cooc(spark, "montague lady capulet romeo".split(), ["romeo", "montague", "lady montague", "capulet", "lady capulet"])
    assert len(got) == 6 and set(got.values()) == {1}


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(words=st.lists(st.sampled_from("abcdxy"), max_size=40), window=st.integers(1, 9))
def test_cooccurrence_against_brute_force(spark, words, window):
    want = Counter()
    for i, a in enumerate(words):
        for b in words[i + 1 : i + window]:
            if a != b and a in "abcd" and b in "abcd":
                want[min(a, b), max(a, b)] += 1
    assert run_cooc(spark, words, list("abcd"), window) == dict(want)


def test_contexts(spark):
    tokens = "a b c ron d ron e f".split()
    books = spark.createDataFrame([("b", tokens)], "book string, tokens array<string>")
    mentions = spark.createDataFrame([("b", 3, "ron"), ("b", 5, "ron")], "book string, pos int, entity string")
    out = contexts.context_texts(contexts.entity_contexts(mentions, books.select("book", F.size("tokens").alias("n_tokens")), 2), books)
    assert [(r.start, r.end, r.text) for r in out.orderBy("ctx_idx").collect()] == [(1, 6, "b c ron d ron"), (4, 8, "d ron e f")]


def test_first_subsequence(spark):
    cases = [(["a", "b", "c", "b", "c"], ["b", "c"], 1), (["A", "B"], ["b"], 1), (["a"], ["z"], 0), ([], ["z"], 0), (["ab", "b"], ["b"], 1)]
    df = spark.createDataFrame([(i, t, w) for i, (t, w, _) in enumerate(cases)], "i int, t array<string>, w array<string>")
    got = [r.at for r in df.select("i", contexts.first_subsequence(F.col("t"), F.col("w")).alias("at")).orderBy("i").collect()]
    assert got == [c[2] for c in cases]


def test_mask_chunks_labels(spark):
    df = spark.createDataFrame([("iron ron weasley", "aaaaaa bb ccc d ee".split(), [5, 103, 7])], "t string, w array<string>, ids array<int>")
    row = df.select(mlmprep.mask_names(F.col("t"), ["ron", "weasley"]).alias("m"), mlmprep.greedy_chunks(F.col("w"), F.transform("w", F.char_length), 5).alias("c"), mlmprep.mask_labels(F.col("ids"), 103).alias("l")).first()
    assert row.m == "i[MASK] [MASK] [MASK]"
    assert row.c == ["", "aaaaaa", "bb ccc", "d ee"]
    assert row.l == [-100, 103, -100]
