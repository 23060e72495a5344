from castgraph.llm import severity


def test_fit_takes_12000_labelled_documents(spark, monkeypatch):
    monkeypatch.setattr(severity, "fit", lambda texts, grades, kinds: len(texts))
    docs = spark.range(13_000).selectExpr("id AS doc_id", "'a text' AS text")
    labels = spark.range(13_000).selectExpr("id AS doc_id", "'r' AS reviewer", "int(id % 2) AS toxic", "timestamp'2024-01-01' AS labelled_at")
    terms = spark.createDataFrame([("x", "y")], "term string, kind string")
    assert severity.fit_model(docs, labels, terms) == 12_000
    assert severity.STEPS == 160


def test_terms_of_several_words():
    kinds = severity.term_kinds([("vile", "insult"), ("vile rat", "insult"), ("you vile rat", "threat")])
    assert len(kinds) == 3
    model = severity.fit([], [], kinds)
    many = severity.fit([], [], severity.term_kinds([("bad green fog", "insult"), ("cold soup", "insult")]))
    assert (many.scores(["a bad green fog", "some cold soup"]) > many.scores(["bad fog green", "cold. soup"])).all()
    assert (model.scores(["vile"]) > model.scores(["calm"])).all()
