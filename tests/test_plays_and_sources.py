from pyspark.sql import functions as F

from castgraph import sources
from castgraph.operators import entities, hypergraph, play, text
from castgraph.plans.facades import Book, Corpus, Play
from castgraph.sources import sinks
from castgraph.streaming import stream_table, token_totals

TEI = """<?xml version="1.0"?><TEI xmlns="http://x"><person xml:id="A"/><personGrp xml:id="G"/><person xml:id="B"/><text><body><div1>
<sp who="#Z"><ab><w>prologue</w></ab></sp><div2><!-- <sp who="#no"/> --><sp who="#A #B"><ab><w>to</w><c> </c><w>be<hi>x</hi></w>tail</ab><ab><w>no</w></ab></sp>
<sp who="#B"><ab><w>or</w></ab></sp><sp><ab/></sp><sp who=""><ab/></sp></div2></div1></body></text></TEI>"""


def test_tei(spark):
    df = spark.createDataFrame([("p", TEI), ("q", None)], "play string, body string")
    rows = play.speeches(df, "play", "body").orderBy("speech_idx").collect()
    assert [(r.speaker, r.text) for r in rows] == [("A", "to be"), ("B", "or"), ("[UNKNOWN]", ""), ("[UNKNOWN]", "")]
    assert [r.character for r in play.characters(df, "play", "body").orderBy("idx").collect()] == ["A", "B", "G", "[UNKNOWN]"]
    p = Play(df)
    assert {(r.char1, r.char2): r.value for r in p.cooccurrences().collect()} == {("A", "B"): 1, ("B", "[UNKNOWN]"): 1}
    assert p.bars().count() == 3


def test_adjacent_metrics(spark):
    vecs = [[1.0, 0.0], [1.0, 1.0], [0.0, 1.0], [1.0, 2.0], [2.0, 1.0]]
    df = spark.createDataFrame([("s", i, c, v, str(i)) for i, (c, v) in enumerate(zip("ABAAC", vecs, strict=True))], "scene string, i int, speaker string, vec array<double>, text string")
    assert {(r.char1, r.char2): r.value for r in play.adjacent_cooccurrence(df, ["scene"], ["i"]).collect()} == {("A", "B"): 2, ("A", "C"): 1}
    got = {(r.char1, r.char2): round(r.value, 6) for r in play.adjacent_cosine_sum(df, ["scene"], ["i"]).collect()}
    assert got == {("A", "B"): round(2**0.5, 6), ("A", "A"): round(2 / 5**0.5, 6), ("A", "C"): 0.8}
    assert play.directed_pairs(df, ["scene"], ["i"]).count() == 3


def test_expansions_agree(spark, small):
    members = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, None)], "edge int, node string")
    assert {(r.node1, r.node2): r["count"] for r in hypergraph.clique_expansion(members).collect()} == {("a", "b"): 2, ("a", "c"): 1, ("b", "c"): 1}
    assert hypergraph.star_expansion(members).count() == 5


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "Ham").mkdir()
    (tmp_path / "Ham" / "Ham.txt").write_text("Hamlet met Horatio. Hamlet left; Horatio stayed with the king", encoding="utf-8")
    (tmp_path / "Ham" / "Entities").write_bytes(b"Hamlet Prince\r\n\r\nHoratio\t friend \r\nKing Claudius")
    texts, aliases = sources.corpus_folder(spark, str(tmp_path))
    assert [r.aliases for r in aliases.orderBy("ent_idx").collect()] == [["hamlet", "prince"], ["horatio", "friend"], ["king", "claudius"]]
    assert {r.name for r in sources.flat_names(spark, str(tmp_path / "*" / "Entities")).collect()} == {"Hamlet", "Prince", "Horatio", "friend", "King", "Claudius"}
    flat = entities.alias_rows(spark, ["hamlet prince", "horatio friend", "king claudius"])
    book = Book(texts, flat)
    assert {(r.char1, r.char2): r["count"] for r in book.cooccurrences().collect()} == {("hamlet", "horatio"): 4, ("hamlet", "king"): 2, ("horatio", "king"): 2}
    assert book.similarities().count() == 3 and book.clustered(2).count() == 3 and book.differences().count() == 3
    with_book = flat.withColumn("book", F.lit("Ham"))
    assert Corpus(texts, with_book).pair_table().filter("same_book = 1").count() == 3
    vecs = spark.createDataFrame([("w", [1.0, -2.5])], "word string, vec array<double>")
    back = sources.vector_lines(spark, sinks.write_vectors_text(vecs, str(tmp_path / "v"))).collect()
    assert [(r.word, r.vec) for r in back] == [("w", [1.0, -2.5])]
    (tmp_path / "v.json").write_text('{"vectors": {"w": [1.0, 2.0]}}')
    assert sources.vector_json(spark, str(tmp_path / "v.json")).first().vec == [1.0, 2.0]
    (tmp_path / "ham_hg-scene-mw.edges.csv").write_text("act,scene,n_tokens,n_lines,onstage\n1,1,10,2,#a #b\n")
    edge = sources.hypergraph_csv(spark, str(tmp_path / "ham_hg-scene-mw.edges.csv"), "scene_edges").first()
    assert (edge.play, edge.onstage) == ("ham", "#a #b")
    (tmp_path / "types.csv").write_text("# note\nplay_name,play_type\nham,tragedy\n")
    assert sources.hypergraph_csv(spark, str(tmp_path / "types.csv"), "play_types").count() == 1
    diff = spark.createDataFrame([("a", "b", 0.5)], "char1 string, char2 string, difference double")
    assert spark.read.csv(sinks.write_differences(diff, str(tmp_path / "d")), sep="\t", header=True).columns == ["Char1", "Char2", "Difference"]


def test_streaming_equals_batch(spark, small):
    docs = sources.table(spark, small, "documents")
    totals = token_totals(stream_table(spark, f"{small}/documents*.parquet", docs), "source", "text")
    q = totals.writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    batch = text.token_counts(docs.select("source", "text"), "source", "text").groupBy("book").agg(F.sum("n_raw").alias("n"))
    assert {(r.source, r.n_raw) for r in spark.table("totals").collect()} == {(r.book, r.n) for r in batch.collect()}
