"""Chainable, lazy pipelines of a book, a play and a corpus."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from castgraph.operators import cluster, compare, contexts, cooccur, embed, entities, play, text, vectors


class Book:
    """Texts (book, text) and one alias table; every step is a property built on the one before."""

    def __init__(self, texts: DataFrame, aliases: DataFrame, stop_words: list[str] | None = None):
        self.texts, self.aliases, self.stop_words = texts, aliases, stop_words

    @cached_property
    def tokens(self) -> DataFrame:
        return entities.canonicalize(text.token_table(self.texts, "book", "text", self.stop_words), self.aliases)

    @cached_property
    def mentions(self) -> DataFrame:
        return entities.mentions(self.tokens, self.aliases)

    def cooccurrences(self, window: int = 15) -> DataFrame:
        return cooccur.cooccurrences(self.mentions, window)

    @cached_property
    def books(self) -> DataFrame:
        """(book, tokens): each text's canonical tokens; a text is one row from the start, so nothing is gathered."""
        names = entities.first_match(self.aliases)
        known = {r["alias"]: r["canonical"] for r in names.limit(contexts.MOST_ALIASES + 1).collect()}
        if len(known) > contexts.MOST_ALIASES:
            return self.tokens.groupBy("book").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "token"))), lambda t: t["token"]).alias("tokens"))
        table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair)) if known else None
        clean = text.clean_tokens(F.col("text"), self.stop_words)
        return self.texts.select("book", (F.transform(clean, lambda t: F.when(t.isin(list(known)), F.element_at(table, t)).otherwise(t)) if known else clean).alias("tokens"))

    def contexts(self, width: int = 10) -> DataFrame:
        """Contexts of the canonical names."""
        named = self.aliases.select(F.col("canonical").alias("alias"), "canonical", "ent_idx").distinct()
        return contexts.mention_contexts(self.books.filter(F.col("tokens").isNotNull()), named, width)

    def entity_vectors(self, width: int = 10, **how) -> DataFrame:
        """(book, name, vec): mean embedding of each entity's contexts."""
        embedded = embed.embed(self.contexts(width), "text", **how)
        return vectors.mean_vectors(embedded, ["book", "entity"], "vec").withColumnRenamed("entity", "name")

    def span_vectors(self, vec: str = "ent_vec", width: int = 10, **how) -> DataFrame:
        """(book, name, vec): mean over each entity's contexts of its own pieces (ent_vec) or of the first piece (cls_vec)."""
        return vectors.mean_vectors(embed.embed_entities(self.contexts(width), **how), ["book", "entity"], vec).withColumnRenamed("entity", "name")

    def similarities(self, **how) -> DataFrame:
        return vectors.pair_similarities(self.entity_vectors(**how), ["name"], ["book"])

    def span_similarities(self, vec: str = "ent_vec", **how) -> DataFrame:
        """(book, char1, char2, value): pairs of entities by their own pieces or the first ones."""
        return vectors.dedup_pairs(vectors.pair_similarities(self.span_vectors(vec, **how), ["name"], ["book"]), ["book"])

    def word_similarities(self, dim: int = 7, window: int = 15, **how) -> DataFrame:
        """(book, char1, char2, value): pairs of entities by word vectors of their book, the most similar first; names without a vector are left out."""
        names = self.aliases.select(F.col("canonical").alias("name")).distinct()
        words = embed.word2vec_by_book(self.books, dim, window, **how).withColumnRenamed("word", "name").join(names, "name", "left_semi")
        return vectors.dedup_pairs(vectors.pair_similarities(words, ["name"], ["book"]), ["book"]).orderBy("book", F.desc("value"), "char1", "char2")

    def _counts(self, window: int) -> DataFrame:
        return self.cooccurrences(window).withColumn("value", F.col("count").cast("double"))

    def differences(self, window: int = 15, words: bool = False, **how) -> DataFrame:
        """Co-occurrence less similarity, by contexts or, if ``words``, by word vectors; rising."""
        right = self.word_similarities(window=window, **how) if words else self.similarities(**how)
        return compare.difference(self._counts(window), right, ["book"]).orderBy("book", "difference", "char1", "char2")

    def clustered(self, k: int = 5, window: int = 15, **how) -> DataFrame:
        cooc = cooccur.corpus_counts(self.cooccurrences(window)).select("char1", "char2", F.col("count").cast("double").alias("value"))
        sims = vectors.dedup_pairs(self.similarities(**how))
        return compare.compare_wide({"cooc": cluster.cluster_values(cooc, k), "similarity": cluster.cluster_values(sims, k)})

    def compared(self, book: str, k: int = 5, window: int = 15) -> DataFrame:
        """The ten columns of a book: four metrics of each pair with their clusters, by rising co-occurrence."""
        one = type(self)(self.texts.filter(F.col("book") == book), self.aliases, self.stop_words) if type(self) is Book else Book(self.texts.filter(F.col("book") == book), self.aliases.filter(F.col("book") == book).drop("book"), self.stop_words)
        metrics = {"cooc": one._counts(window), "w2v": one.word_similarities(window=window), "bert_entity": one.span_similarities("ent_vec"), "bert_cls": one.span_similarities("cls_vec")}
        wide = compare.compare_wide({name: cluster.cluster_values(df.select("char1", "char2", "value"), k) for name, df in metrics.items()})
        return wide.orderBy("cooc", "char1", "char2")


class Play:
    """TEI plays (play, body)."""

    def __init__(self, plays: DataFrame):
        self.plays = plays

    @cached_property
    def speeches(self) -> DataFrame:
        return play.speeches(self.plays, "play", "body")

    @cached_property
    def characters(self) -> DataFrame:
        return play.characters(self.plays, "play", "body")

    def cooccurrences(self) -> DataFrame:
        return play.adjacent_cooccurrence(self.speeches, ["play", "scene_idx"], ["speech_idx"])

    def cosines(self, **how) -> DataFrame:
        return play.adjacent_cosine_sum(embed.embed(self.speeches, "text", **how), ["play", "scene_idx"], ["speech_idx"])

    def scatter(self, only: list[str] | None = None) -> DataFrame:
        names = self.speeches.select(F.col("speaker").alias("name")).distinct()
        names = names.filter(F.col("name").isin(only)) if only else names
        numbered = names.withColumn("idx", F.col("name"))
        return compare.scatter_frame(numbered, self.cooccurrences(), self.cosines())

    def bars(self, only: list[str] | None = None) -> DataFrame:
        return compare.difference_bars(self.scatter(only)).orderBy(F.desc("difference"), "label")


class Corpus(Book):
    """Several books with alias tables of their own: aliases (book, ent_idx, canonical, alias_idx, alias)."""

    def __init__(self, texts: DataFrame, aliases: DataFrame, stop_words: list[str] | None = None):
        """All-pairs tables are as large as the corpus's list of names squared: they are meant for casts, not for vocabularies."""
        super().__init__(texts, aliases, stop_words)
        self.lists = aliases.select("book", F.col("canonical").alias("name")).distinct()

    def pair_table(self, **how) -> DataFrame:
        """(char1, char2, value, same_book, char_book, char2_book): all pairs of the corpus's entities."""
        newest = self.entity_vectors(**how).groupBy("name").agg(F.max_by("vec", "book").alias("vec"))
        pairs = compare.same_book(vectors.pair_similarities(newest, ["name"]).select("char1", "char2", "value"), self.lists)
        books = compare.entity_book(self.lists)
        side = lambda c, b: books.select(F.col("name").alias(c), F.col("book").alias(b))
        return pairs.join(side("char1", "char_book"), "char1", "left").join(side("char2", "char2_book"), "char2", "left").select("char1", "char2", "value", "same_book", "char_book", "char2_book")

    def compared_pairs(self, window: int = 15) -> DataFrame:
        """The corpus table (char1, char2, w2v, same_book, char_book, char2_book, bert): pairs that have both similarities, of each name's vectors in its last book."""
        words = embed.word2vec_by_book(self.books, window=window).withColumnRenamed("word", "name").join(self.lists.select("name").distinct(), "name", "left_semi")
        newest = lambda df: df.groupBy("name").agg(F.max_by("vec", "book").alias("vec"))
        side = lambda df: vectors.dedup_pairs(vectors.pair_similarities(newest(df), ["name"]))
        pairs = compare.same_book(compare.aligned(side(words), side(self.span_vectors())), self.lists)
        books = compare.entity_book(self.lists)
        of = lambda c, b: books.select(F.col("name").alias(c), F.col("book").alias(b))
        joined = pairs.join(of("char1", "char_book"), "char1", "left").join(of("char2", "char2_book"), "char2", "left")
        return joined.select("char1", "char2", F.col("a").alias("w2v"), "same_book", "char_book", "char2_book", F.col("b").alias("bert"))

    def book_means(self, **how) -> DataFrame:
        return compare.book_matrix(self.pair_table(**how).select(F.col("char_book").alias("book1"), F.col("char2_book").alias("book2"), "value"))
