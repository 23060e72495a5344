"""Queries of the relationship operators over the project's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.functions import once
from castgraph.functions.words import PUNCTUATION, STOP_WORDS, WHITE_SPACE
from castgraph.operators import cluster, compare, contexts, cooccur, embed, entities, hypergraph, mlmprep, play, text, vectors
from castgraph.sources import sinks, table

#: The alias lines of these queries; two of them share an alias, so the two resolutions differ. Fixed values.
ALIAS_LINES = ["lantern lamp", "crown couronne krone corona", "kettle", "market bazaar lantern", "chapel kapelle chapelle capilla", "mirror miroir spiegel", "winter", "journey voyage reise", "candle kerze bougie vela", "harbour", "mill mühle moulin molino", "wedding hochzeit"]
MASKED = ["lantern", "crown", "chapel", "Krone"]
WINDOW, WIDTH = 15, 10
ALLOWED = ("click", "view")  # event types of the filtered scatter frame


def _aliases(spark: SparkSession) -> DataFrame:
    return entities.alias_rows(spark, ALIAS_LINES)


def _tokens(spark, d) -> DataFrame:
    return text.token_table(table(spark, d, "documents"), "doc_id", "text")


def _canonical(spark, d) -> DataFrame:
    return entities.canonicalize(_tokens(spark, d), _aliases(spark))


def _mentions(spark, d) -> DataFrame:
    return entities.mentions(_canonical(spark, d), _aliases(spark))


def tokens_clean_count(spark, d):
    return text.token_counts(table(spark, d, "documents"), "doc_id", "text")


def cooc_window15(spark, d):
    return cooccur.cooccurrences(_mentions(spark, d), WINDOW)


def cooc_corpus(spark, d):
    return cooccur.corpus_counts(cooc_window15(spark, d))


def entity_contexts(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("book"), text.clean_tokens(F.col("text")).alias("tokens"))
    return contexts.mention_contexts(docs, _aliases(spark), WIDTH).withColumnRenamed("start", "ctx_start").withColumnRenamed("end", "ctx_end")


def _named_vectors(spark, d) -> DataFrame:
    v = table(spark, d, "vectors").withColumn("space", F.lower("space"))
    size = (F.col("space") == "w2v") & (F.size("vec") == 80) | (F.col("space") == "bert") & (F.size("vec") == 96)
    return v.filter(size & ~F.exists("vec", F.isnan))


def vector_mean_by_entity(spark, d):
    return vectors.mean_long(_named_vectors(spark, d), ["book", "word", "space"], "vec").withColumn("avg", F.round("avg", 6))


def _label_means(spark, d) -> DataFrame:
    return vectors.mean_vectors(table(spark, d, "embeddings"), ["label"], "embedding").select(F.col("label").alias("name"), "vec")


def cosine_pairs(spark, d):
    return vectors.pair_similarities(_label_means(spark, d), ["name"]).select("char1", "char2", F.round("value", 6).alias("value"))


def pair_dedup_max(spark, d):
    p = table(spark, d, "corpus_pairs").filter("cosine_similarity_w2v IS NOT NULL AND NOT isnan(cosine_similarity_w2v)")
    p = p.select("char1", "char2", F.col("cosine_similarity_w2v").alias("value"), F.col("ctx1").alias("idx1"), F.col("ctx2").alias("idx2"))
    return vectors.dedup_pairs(p).select("char1", "char2", F.round("value", 6).alias("value"))


def corpus_pair_cosines(spark, d):
    """Both cosines of every listed pair of contexts, from the vectors delivered last."""
    usable = _named_vectors(spark, d).filter("ctx_id IS NOT NULL").filter(F.exists("vec", lambda x: x != 0))
    last = usable.groupBy("ctx_id", "space").agg(F.max_by("vec", F.struct("made_at", "vec_id")).alias("vec"))
    both = last.groupBy("ctx_id").agg(F.max(F.when(F.col("space") == "w2v", F.col("vec"))).alias("w"), F.max(F.when(F.col("space") == "bert", F.col("vec"))).alias("b"))
    side = lambda k: both.select(F.col("ctx_id").alias(f"ctx{k}"), F.col("w").alias(f"w{k}"), F.col("b").alias(f"b{k}"))
    joined = table(spark, d, "corpus_pairs").select("ctx1", "ctx2", "char1", "char2").join(side(1), "ctx1", "left").join(side(2), "ctx2", "left")
    return joined.select("ctx1", "ctx2", "char1", "char2", F.round(vectors.cosine(F.col("w1"), F.col("w2")), 6).alias("w2v"), F.round(vectors.cosine(F.col("b1"), F.col("b2")), 6).alias("bert"))


def _speeches(spark, d) -> DataFrame:
    return table(spark, d, "events").select(F.col("user_id").alias("scene"), "ts", F.col("event_id").alias("n"), F.col("event_type").alias("speaker"))


def adjacent_speech_cooc(spark, d):
    return play.adjacent_cooccurrence(_speeches(spark, d), ["scene"], ["ts", "n"])


def _adjacent_cosines(spark, d) -> DataFrame:
    """A speech's vector is vec_id = event_id % n, n being the size of the embeddings table."""
    vecs = table(spark, d, "embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("vec"))
    size = F.broadcast(vecs.agg(F.count(F.lit(1)).alias("size")))
    spoken = _speeches(spark, d).crossJoin(size).withColumn("k", F.col("n") % F.nullif("size", F.lit(0))).drop("size").join(vecs, "k")
    return play.adjacent_cosine_sum(spoken, ["scene"], ["ts", "n"])


def adjacent_speech_cosine_sum(spark, d):
    return _adjacent_cosines(spark, d).withColumn("value", F.round("value", 5))


def speech_pairs_directed(spark, d):
    said = _speeches(spark, d).withColumn("text", F.col("n").cast("string"))
    return play.directed_pairs(said, ["scene"], ["ts", "n"]).select("scene", "n", "char1", "char2", "text1", "text2")


def _cooc_value(spark, d) -> DataFrame:
    return adjacent_speech_cooc(spark, d).withColumn("value", F.col("value").cast("double"))


def metric_difference(spark, d):
    return compare.difference(_cooc_value(spark, d), _adjacent_cosines(spark, d)).withColumn("difference", F.round("difference", 5))


def metric_compare_wide(spark, d):
    out = compare.compare_wide({"cooc": _cooc_value(spark, d), "cosine": _adjacent_cosines(spark, d)})
    return out.withColumn("cosine", F.round("cosine", 5))


def heatmap_matrix_long(spark, d):
    return compare.heat_map(adjacent_speech_cooc(spark, d))


def _scatter(spark, d) -> DataFrame:
    names = table(spark, d, "events").select(F.col("event_type").alias("name"), F.col("event_type").alias("idx")).distinct()
    return compare.scatter_frame(names, _cooc_value(spark, d), _adjacent_cosines(spark, d))


def scatter_frame(spark, d):
    return _scatter(spark, d).withColumn("cosine", F.round("cosine", 5))


def trend_line(spark, d):
    return compare.trend(_scatter(spark, d)).select(F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


def diff_bar(spark, d):
    return compare.difference_bars(_scatter(spark, d)).select("label", F.round("difference", 5).alias("difference"), F.round("shade", 5).alias("shade"))


def _cooc_pairs(spark, d) -> DataFrame:
    return cooc_corpus(spark, d).select("char1", "char2", F.col("count").cast("double").alias("value"))


def graph_edges_inverse_weight(spark, d):
    return compare.graph(_cooc_pairs(spark, d))[1].withColumn("weight", F.round("weight", 9))


def graph_nodes(spark, d):
    return compare.graph(_cooc_pairs(spark, d))[0]


def _lists(spark, d) -> DataFrame:
    return table(spark, d, "vectors").select("book", F.col("word").alias("name")).dropna().distinct()


def same_book_flag(spark, d):
    pairs = table(spark, d, "corpus_pairs").select("char1", "char2").dropna().distinct()
    return compare.same_book(pairs, _lists(spark, d)).select("char1", "char2", "same_book")


def entity_book_lookup(spark, d):
    return compare.entity_book(_lists(spark, d))


def book_matrix_mean(spark, d):
    p = table(spark, d, "corpus_pairs").filter("cosine_similarity_w2v IS NOT NULL AND NOT isnan(cosine_similarity_w2v) AND char_book IS NOT NULL AND char2_book IS NOT NULL")
    out = compare.book_matrix(p.select(F.col("char_book").alias("book1"), F.col("char2_book").alias("book2"), F.col("cosine_similarity_w2v").alias("value")), dense=False)
    return out.withColumn("mean", F.round("mean", 6))


def _order_members(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), lines["l_partkey"] == F.col("p_partkey")).select(F.col("l_orderkey").alias("edge"), F.col("p_brand").alias("node"))


def order_clique_expansion(spark, d):
    return hypergraph.clique_expansion(_order_members(spark, d))


def order_star_expansion(spark, d):
    return hypergraph.star_expansion(_order_members(spark, d))


def order_node_totals(spark, d):
    lines = table(spark, d, "lineitem").select("l_partkey", "l_quantity")
    named = lines.join(table(spark, d, "part").select("p_partkey", "p_brand"), lines["l_partkey"] == F.col("p_partkey"))
    return hypergraph.node_totals(named.select(F.col("p_brand").alias("node"), "l_quantity"), ["l_quantity"]).withColumn("l_quantity", F.round("l_quantity", 2))


def clique_edges_merged(spark, d):
    return hypergraph.merged_clique_edges(table(spark, d, "clique_edges"))


def cast_links(spark, d):
    return hypergraph.cast_links(table(spark, d, "cast_list"))


def play_types(spark, d):
    return hypergraph.play_types(table(spark, d, "play_types"))


def mask_entities(spark, d):
    return table(spark, d, "documents").select("doc_id", mlmprep.mask_names(F.col("text"), MASKED).alias("text"))


def greedy_chunks(spark, d):
    return mlmprep.chunk_table(table(spark, d, "documents"), "doc_id", "text", MASKED)


def cluster_pairs_kmeans1d(spark, d):
    return cluster.cluster_values(_cooc_pairs(spark, d))


def dbscan1d(spark, d):
    rows = table(spark, d, "hyperedges").select("row_id", "play", "n_tokens")
    return cluster.dbscan_1d(rows, "n_tokens", 3.0, 4, ["play"])


def first_subsequence(spark, d):
    docs = once(table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text"), "words", text.raw_tokens(F.col("text")))
    return docs.select("doc_id", contexts.first_subsequence(F.col("words"), F.array(F.lit("the"), F.lit("lantern"))).alias("place"))


def tei_speeches(spark, d):
    return play.speeches(table(spark, d, "play_records"), "record_id", "body").withColumnRenamed("play", "record_id")


def tei_tags(spark, d):
    return play.tags(table(spark, d, "play_records"), "record_id", "body", "speaker").withColumnRenamed("play", "record_id")


def tei_characters(spark, d):
    return play.characters(table(spark, d, "play_records"), "record_id", "body").withColumnRenamed("play", "record_id")


def word2vec_vectors(spark, d):
    """The tokens of ``_canonical``, replaced inside their row, which saves the shuffle of the tokens."""
    names = {r.alias: r.canonical for r in entities.first_match(_aliases(spark)).collect()}
    to = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    docs = once(table(spark, d, "documents").select("text"), "tokens", text.clean_tokens(F.col("text")))
    return embed.word2vec_of(docs.select(F.transform("tokens", lambda t: F.when(t.isin(list(names)), to[t]).otherwise(t)).alias("tokens")), partitions=8)


def pca_projection(spark, d):
    """The first three components of each embedding with its colour group."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    out, _ = vectors.principal_components(rows, "embedding", 3, ["vec_id", "label"])
    return out.select("vec_id", "label", *(F.col("pc")[i].alias(f"pc{i + 1}") for i in range(3)))


def pca_variance(spark, d):
    """The share of the variance that each of the three components explains."""
    _, ratios = vectors.principal_components(table(spark, d, "embeddings").select("vec_id", "embedding"), "embedding", 3, ["vec_id"])
    return spark.createDataFrame([(i + 1, float(r)) for i, r in enumerate(ratios)], "component int, ratio double")


def spring_layout(spark, d):
    nodes, edges = compare.graph(_cooc_pairs(spark, d))
    return compare.spring_layout(nodes, edges)


def context_vectors(spark, d):
    """Mean hashed embedding of each entity's contexts, by language."""
    lang = table(spark, d, "documents").select(F.col("doc_id").alias("book"), F.lower(F.substring(F.trim("lang"), 1, 2)).alias("lang"))
    ctx = entity_contexts(spark, d).join(lang, "book")
    return vectors.mean_long(embed.embed(ctx, "text"), ["lang", "entity"], "vec")


def pairs_aligned(spark, d):
    """Pairs that have both similarities, with the greatest of each."""
    p = table(spark, d, "corpus_pairs")
    side = lambda c: p.filter(F.col(c).isNotNull() & ~F.isnan(c)).select("char1", "char2", F.col(c).alias("value"))
    out = compare.aligned(side("cosine_similarity_w2v"), side("cosine_similarity_bert"))
    return out.select("char1", "char2", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def shared_vocabulary(spark, d):
    """Words with usable vectors of both spaces, and the last book that has one."""
    v = _named_vectors(spark, d).select("word", "book", "space").dropna()
    return v.groupBy("word").agg(F.max("book").alias("book"), F.count_distinct("space").alias("n")).filter("n = 2").drop("n")


def graph_node_books(spark, d):
    lists = _lists(spark, d)
    nodes, _ = compare.graph(table(spark, d, "corpus_pairs").select("char1", "char2", F.lit(1.0).alias("value")), "w2v")
    return compare.node_groups(nodes.filter("id IS NOT NULL"), compare.entity_book(lists))


def _listed_pairs(spark, d) -> DataFrame:
    p = table(spark, d, "corpus_pairs").filter("char1 IS NOT NULL AND char2 IS NOT NULL")
    good = lambda c: F.when(~F.isnan(c), F.col(c))
    return p.select("char1", "char2", good("cosine_similarity_w2v").alias("w2v"), good("cosine_similarity_bert").alias("bert"), "same_book")


def metric_compare_four(spark, d):
    """Four metrics of each listed pair, each in two clusters: how often it is listed, the greatest cosine of either space, the least of the contextual one."""
    p = _listed_pairs(spark, d)
    by = lambda value: p.groupBy(F.least("char1", "char2").alias("char1"), F.greatest("char1", "char2").alias("char2")).agg(F.round(value.cast("double"), 4).alias("value")).filter("value IS NOT NULL")
    metrics = {"cooc": by(F.count(F.lit(1))), "w2v": by(F.max("w2v")), "bert": by(F.max("bert")), "bert_least": by(F.min("bert"))}
    return compare.compare_wide({name: cluster.cluster_values(df, 2) for name, df in metrics.items()})


def book_matrix_dense(spark, d):
    """As book_matrix_mean, with a cell for every two books."""
    p = table(spark, d, "corpus_pairs").filter("cosine_similarity_w2v IS NOT NULL AND NOT isnan(cosine_similarity_w2v) AND char_book IS NOT NULL AND char2_book IS NOT NULL")
    return compare.book_matrix(p.select(F.col("char_book").alias("book1"), F.col("char2_book").alias("book2"), F.col("cosine_similarity_w2v").alias("value"))).withColumn("mean", F.round("mean", 6))


def w2v_pair_list(spark, d):
    """The pairs of each book's words by their mean word vectors; of a pair listed in several books the most similar."""
    means = vectors.mean_vectors(_named_vectors(spark, d).filter("space = 'w2v' AND book IS NOT NULL AND word IS NOT NULL"), ["book", "word"], "vec").withColumnRenamed("word", "name")
    pairs = vectors.pair_similarities(means, ["name"], ["book"]).withColumn("value", F.round("value", 6)).filter("value IS NOT NULL")
    return vectors.dedup_pairs(pairs).orderBy(F.desc("value"), "char1", "char2")


def pairs_with_vectors(spark, d):
    """Listed pairs both of whose names have a usable word vector."""
    names = _named_vectors(spark, d).filter("space = 'w2v'").select("word").dropna().distinct()
    pairs = table(spark, d, "corpus_pairs").select("char1", "char2").dropna().distinct()
    return pairs.join(names.withColumnRenamed("word", "char1"), "char1", "left_semi").join(names.withColumnRenamed("word", "char2"), "char2", "left_semi").select("char1", "char2")


def scatter_allowed(spark, d):
    """The scatter frame of the allowed characters, the most co-occurring first."""
    kept = _scatter(spark, d).filter(F.col("char1").isin(*ALLOWED) & F.col("char2").isin(*ALLOWED))
    return kept.withColumn("cosine", F.round("cosine", 5)).orderBy(F.desc("cooc"), "char1", "char2")


def mask_labels(spark, d):
    """Labels of the masked words' places, a word's id being its length: how many are kept, and the sum of all."""
    words = F.split(mlmprep.mask_names(F.col("text"), MASKED), " ")
    docs = once(table(spark, d, "documents").filter(F.col("text").isNotNull()).select("doc_id", "text"), "labels", mlmprep.mask_labels(F.transform(words, F.char_length), len(mlmprep.MASK)))
    return docs.select("doc_id", F.size(F.filter("labels", lambda x: x >= 0)).alias("n_kept"), F.aggregate("labels", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"))


def cluster_ranks(spark, d):
    """Languages as clusters, ranked by the mean length of their texts."""
    lang = F.lower(F.substring(F.trim("lang"), 1, 2))
    means = table(spark, d, "documents").select(lang.alias("lang"), F.char_length("text").alias("n")).dropna().groupBy("lang").agg(F.avg("n").alias("centre"))
    return cluster.rank_labels(means).select("lang", "cluster")


def entity_report(spark, d):
    return sinks.entity_report(_aliases(spark))


QUERIES = {
    f.__name__: f
    for f in (
        tokens_clean_count, cooc_window15, cooc_corpus, entity_contexts, vector_mean_by_entity, cosine_pairs, pair_dedup_max, corpus_pair_cosines, adjacent_speech_cooc,
        adjacent_speech_cosine_sum, speech_pairs_directed, metric_difference, metric_compare_wide, heatmap_matrix_long, scatter_frame, trend_line, diff_bar,
        graph_edges_inverse_weight, graph_nodes, same_book_flag, entity_book_lookup, book_matrix_mean, order_clique_expansion, order_star_expansion, order_node_totals,
        clique_edges_merged, cast_links, play_types, mask_entities, greedy_chunks, cluster_pairs_kmeans1d, dbscan1d, first_subsequence, tei_speeches, tei_tags,
        word2vec_vectors, pca_projection, spring_layout, context_vectors, pairs_aligned, shared_vocabulary, graph_node_books, entity_report,
        tei_characters, pca_variance, metric_compare_four, book_matrix_dense, w2v_pair_list, pairs_with_vectors, scatter_allowed, mask_labels, cluster_ranks,
    )
} | {"token_positions": _tokens, "canonicalize_first_match": _canonical, "mentions_last_match": _mentions}


# -- SQL ------------------------------------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _with(upto: str, query: str) -> str:
    rows = [(i, names[0], a) for i, names in enumerate(line.split() for line in ALIAS_LINES) for a in names]
    ctes = [
        ("raw", f"SELECT doc_id AS book, list_filter(regexp_split_to_array(lower(text), {_q(WHITE_SPACE)}), lambda x: x <> '') AS w FROM documents"),
        ("clean", f"SELECT book, list_filter(list_transform(w, lambda x: translate(x, {_q(PUNCTUATION)}, '')), lambda x: NOT list_contains([{', '.join(map(_q, STOP_WORDS))}], x)) AS w FROM raw"),
        ("tokens", "SELECT book, (generate_subscripts(w, 1) - 1)::INTEGER AS pos, unnest(w) AS token FROM clean"),
        ("aliases", "SELECT * FROM (VALUES " + ", ".join(f"({i}, {_q(c)}, {_q(a)})" for i, c, a in rows) + ") t(ent_idx, canonical, alias)"),
        ("firsts", "SELECT alias, arg_min(canonical, ent_idx) AS canonical FROM aliases GROUP BY alias"),
        ("lasts", "SELECT alias, arg_max(canonical, ent_idx) AS canonical FROM aliases GROUP BY alias"),
        ("canon", "SELECT book, pos, coalesce(canonical, token) AS token FROM tokens LEFT JOIN firsts ON token = alias"),
        ("mentions", "SELECT book, pos, canonical AS entity FROM canon JOIN lasts ON token = alias"),
        ("cooc", f"SELECT l.book, least(l.entity, r.entity) AS char1, greatest(l.entity, r.entity) AS char2, count(*) AS count, min(l.pos) AS first_left, arg_min(r.pos, l.pos::BIGINT * 1000000000 + r.pos) AS first_right FROM mentions l JOIN mentions r ON l.book = r.book AND r.pos > l.pos AND r.pos - l.pos < {WINDOW} AND l.entity <> r.entity GROUP BY ALL"),
        ("corpus", "SELECT char1, char2, sum(count)::BIGINT AS count FROM cooc GROUP BY ALL"),
    ]
    names = [n for n, _ in ctes]
    return "WITH " + ", ".join(f"{n} AS ({s})" for n, s in ctes[: names.index(upto) + 1]) + " " + query


_SPOKEN = "WITH spoken AS (SELECT user_id AS scene, ts, event_id AS n, event_type AS speaker, lead(event_type) OVER w AS nxt, lead(event_id) OVER w AS nn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), cooc AS (SELECT least(speaker, nxt) AS char1, greatest(speaker, nxt) AS char2, count(*) AS value FROM spoken WHERE nxt IS NOT NULL AND speaker <> nxt GROUP BY ALL)"
_COS = _SPOKEN + f", cos AS (SELECT least(speaker, nxt) AS char1, greatest(speaker, nxt) AS char2, sum(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS value FROM spoken JOIN embeddings a ON a.vec_id = n % (SELECT count(*) FROM embeddings) JOIN embeddings b ON b.vec_id = nn % (SELECT count(*) FROM embeddings) WHERE nxt IS NOT NULL GROUP BY ALL)"
_FRAME = _COS + ", names AS (SELECT DISTINCT event_type AS name FROM events), frame AS (SELECT a.name AS char1, b.name AS char2, coalesce(c.value::DOUBLE, 0.0) AS cooc, coalesce(s.value, 0.0) AS cosine FROM names a JOIN names b ON a.name < b.name LEFT JOIN cooc c ON c.char1 = a.name AND c.char2 = b.name LEFT JOIN cos s ON s.char1 = a.name AND s.char2 = b.name)"
_VALID = "SELECT *, lower(space) AS sp FROM vectors WHERE ((lower(space) = 'w2v' AND len(vec) = 80) OR (lower(space) = 'bert' AND len(vec) = 96)) AND len(list_filter(vec, lambda x: isnan(x))) = 0"
_GOOD = "cosine_similarity_w2v IS NOT NULL AND NOT isnan(cosine_similarity_w2v)"
_MEMBERS = "members AS (SELECT DISTINCT l_orderkey AS edge, p_brand AS node FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL)"


def _masked(column: str) -> str:
    for name in MASKED:
        column = f"replace({column}, {_q(name)}, '[MASK]')"
    return column


def _two_clusters(name: str) -> str:
    """CTEs: the best cut of the values of a metric into two, by the squared error of every cut of the distinct values."""
    return (
        f"{name}_d AS (SELECT value AS v, count(*) AS n FROM {name} GROUP BY value), "
        f"{name}_s AS (SELECT v, sum(n) OVER w AS n1, sum(n * v) OVER w AS s1, sum(n) OVER () AS n0, sum(n * v) OVER () AS s0 FROM {name}_d WINDOW w AS (ORDER BY v)), "
        f"{name}_k AS (SELECT {name}.*, (value > (SELECT v FROM {name}_s WHERE n1 < n0 ORDER BY s1 * s1 / n1 + (s0 - s1) * (s0 - s1) / (n0 - n1) DESC, v LIMIT 1))::INTEGER AS cluster FROM {name})"
    )


_FOUR = {"cooc": "count(*)", "w2v": "max(w2v)", "bert": "max(bert)", "bert_least": "min(bert)"}
_LISTED = "p AS (SELECT least(char1, char2) AS char1, greatest(char1, char2) AS char2, CASE WHEN NOT isnan(cosine_similarity_w2v) THEN cosine_similarity_w2v END AS w2v, CASE WHEN NOT isnan(cosine_similarity_bert) THEN cosine_similarity_bert END AS bert FROM corpus_pairs WHERE char1 IS NOT NULL AND char2 IS NOT NULL)"
_COMPARE_FOUR = (
    f"WITH {_LISTED}, "
    + ", ".join(f"{m} AS (SELECT char1, char2, round(({agg})::DOUBLE, 4) AS value FROM p GROUP BY ALL HAVING {agg} IS NOT NULL), {_two_clusters(m)}" for m, agg in _FOUR.items())
    + ", keys AS (SELECT DISTINCT char1, char2 FROM p) SELECT char1, char2, "
    + ", ".join(f"coalesce({m}_k.value, 0.0) AS {m}, coalesce({m}_k.cluster, 0) AS {m}_cluster" for m in _FOUR)
    + " FROM keys "
    + " ".join(f"LEFT JOIN {m}_k USING (char1, char2)" for m in _FOUR)
)


def _words(column: str) -> str:
    return f"list_filter(regexp_split_to_array({column}, {_q(WHITE_SPACE)}), lambda x: x <> '')"


SQL = {
    "tokens_clean_count": _with("clean", "SELECT raw.book, coalesce(len(raw.w), 0)::INTEGER AS n_raw, coalesce(len(clean.w), 0)::INTEGER AS n_clean FROM raw JOIN clean USING (book)"),
    "token_positions": _with("tokens", "SELECT book, pos, token FROM tokens"),
    "canonicalize_first_match": _with("canon", "SELECT book, pos, token FROM canon"),
    "mentions_last_match": _with("mentions", "SELECT book, pos, entity FROM mentions"),
    "cooc_window15": _with("cooc", "SELECT * FROM cooc"),
    "cooc_corpus": _with("corpus", "SELECT * FROM corpus"),
    "graph_edges_inverse_weight": _with("corpus", "SELECT char1 AS src, char2 AS dst, round(1.0::DOUBLE / count, 9) AS weight FROM corpus"),
    "graph_nodes": _with("corpus", "SELECT char1 AS id FROM corpus UNION SELECT char2 FROM corpus"),
    "entity_contexts": _with("mentions", f"SELECT book, entity, ctx_idx, ctx_start, ctx_end, array_to_string(w[ctx_start + 1 : ctx_end], ' ') AS text FROM (SELECT m.book, entity, (row_number() OVER o - 1)::INTEGER AS ctx_idx, greatest(pos - {WIDTH}, coalesce(lag(pos) OVER o, -1) + 1) AS ctx_start, least(pos + {WIDTH} + 1, len(w))::INTEGER AS ctx_end, w FROM mentions m JOIN clean USING (book) WINDOW o AS (PARTITION BY m.book, entity ORDER BY pos))"),
    "vector_mean_by_entity": f"WITH v AS ({_VALID}) SELECT book, word, space, dim, round(avg(x), 6) AS avg FROM (SELECT book, word, sp AS space, (generate_subscripts(vec, 1) - 1)::INTEGER AS dim, unnest(vec)::DOUBLE AS x FROM v) GROUP BY ALL",
    "cosine_pairs": "WITH x AS (SELECT label, generate_subscripts(embedding, 1) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), m AS (SELECT label, dim, avg(x) AS x FROM x GROUP BY ALL), v AS (SELECT label, list(x ORDER BY dim) AS vec FROM m GROUP BY label) SELECT a.label AS char1, b.label AS char2, round(list_cosine_similarity(a.vec, b.vec), 6) AS value FROM v a JOIN v b ON a.label < b.label",
    "pair_dedup_max": f"SELECT char1, char2, round(cosine_similarity_w2v, 6) AS value FROM corpus_pairs WHERE {_GOOD} QUALIFY row_number() OVER (PARTITION BY least(char1, char2), greatest(char1, char2) ORDER BY cosine_similarity_w2v DESC, ctx1, ctx2) = 1",
    "corpus_pair_cosines": f"WITH v AS ({_VALID}), u AS (SELECT ctx_id, sp, vec::DOUBLE[] AS vec FROM v WHERE ctx_id IS NOT NULL AND len(list_filter(vec, lambda x: x <> 0)) > 0 QUALIFY row_number() OVER (PARTITION BY ctx_id, sp ORDER BY made_at DESC NULLS LAST, vec_id DESC) = 1) SELECT p.ctx1, p.ctx2, char1, char2, round(list_cosine_similarity(w1.vec, w2.vec), 6) AS w2v, round(list_cosine_similarity(b1.vec, b2.vec), 6) AS bert FROM corpus_pairs p LEFT JOIN u w1 ON w1.ctx_id = ctx1 AND w1.sp = 'w2v' LEFT JOIN u w2 ON w2.ctx_id = ctx2 AND w2.sp = 'w2v' LEFT JOIN u b1 ON b1.ctx_id = ctx1 AND b1.sp = 'bert' LEFT JOIN u b2 ON b2.ctx_id = ctx2 AND b2.sp = 'bert'",
    "adjacent_speech_cooc": _SPOKEN + " SELECT * FROM cooc",
    "adjacent_speech_cosine_sum": _COS + " SELECT char1, char2, round(value, 5) AS value FROM cos",
    "speech_pairs_directed": _SPOKEN + " SELECT scene, n, speaker AS char1, nxt AS char2, n::VARCHAR AS text1, nn::VARCHAR AS text2 FROM spoken WHERE nxt IS NOT NULL AND speaker <> nxt",
    "metric_difference": _COS + " SELECT c.char1, c.char2, round(c.value::DOUBLE / (SELECT max(value) FROM cooc) - s.value, 5) AS difference FROM cooc c JOIN cos s ON c.char1 = s.char1 AND c.char2 = s.char2",
    "metric_compare_wide": _COS + " SELECT coalesce(c.char1, s.char1) AS char1, coalesce(c.char2, s.char2) AS char2, coalesce(c.value::DOUBLE, 0.0) AS cooc, 0 AS cooc_cluster, round(coalesce(s.value, 0.0), 5) AS cosine, 0 AS cosine_cluster FROM cooc c FULL JOIN cos s ON c.char1 = s.char1 AND c.char2 = s.char2",
    "heatmap_matrix_long": _SPOKEN + ", sides AS (SELECT char1 AS row, char2 AS col, value FROM cooc UNION ALL SELECT char2, char1, value FROM cooc), labels AS (SELECT DISTINCT row AS label FROM sides) SELECT a.label AS row, b.label AS col, coalesce(sum(value), 0)::BIGINT AS value FROM labels a CROSS JOIN labels b LEFT JOIN sides s ON s.row = a.label AND s.col = b.label GROUP BY ALL",
    "scatter_frame": _FRAME + " SELECT char1, char2, cooc, round(cosine, 5) AS cosine FROM frame",
    "trend_line": _FRAME + " SELECT round(regr_slope(cosine, cooc), 6) AS slope, round(regr_intercept(cosine, cooc), 4) AS intercept FROM frame",
    "diff_bar": _FRAME + ", d AS (SELECT char1 || '-' || char2 AS label, cooc - cosine AS difference FROM frame) SELECT label, round(difference, 5) AS difference, round(CASE WHEN max(difference) OVER () > min(difference) OVER () THEN (difference - min(difference) OVER ()) / (max(difference) OVER () - min(difference) OVER ()) ELSE 0.0 END, 5) AS shade FROM d",
    "same_book_flag": "WITH lists AS (SELECT DISTINCT book, word FROM vectors WHERE book IS NOT NULL AND word IS NOT NULL), pairs AS (SELECT DISTINCT char1, char2 FROM corpus_pairs WHERE char1 IS NOT NULL AND char2 IS NOT NULL) SELECT char1, char2, CASE WHEN EXISTS (SELECT 1 FROM lists a JOIN lists b ON a.book = b.book WHERE a.word = char1 AND b.word = char2) THEN 1 ELSE 0 END AS same_book FROM pairs",
    "entity_book_lookup": "SELECT word AS name, max(book) AS book FROM vectors WHERE book IS NOT NULL AND word IS NOT NULL GROUP BY word",
    "book_matrix_mean": f"WITH p AS (SELECT least(char_book, char2_book) AS a, greatest(char_book, char2_book) AS b, avg(cosine_similarity_w2v) AS mean FROM corpus_pairs WHERE {_GOOD} AND char_book IS NOT NULL AND char2_book IS NOT NULL GROUP BY ALL) SELECT a AS book_i, b AS book_j, round(mean, 6) AS mean FROM p UNION ALL SELECT b, a, round(mean, 6) FROM p WHERE a <> b",
    "order_clique_expansion": f"WITH {_MEMBERS} SELECT a.node AS node1, b.node AS node2, count(*) AS count FROM members a JOIN members b ON a.edge = b.edge AND a.node < b.node GROUP BY ALL",
    "order_star_expansion": f"WITH {_MEMBERS} SELECT edge, node FROM members",
    "order_node_totals": "SELECT p_brand AS node, round(sum(l_quantity), 2) AS l_quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY p_brand",
    "clique_edges_merged": "SELECT play, least(node1, node2) AS node1, greatest(node1, node2) AS node2, max(count) AS count FROM clique_edges WHERE node1 IS NOT NULL AND node2 IS NOT NULL AND count IS NOT NULL GROUP BY ALL",
    "cast_links": "SELECT DISTINCT play, xml_id, regexp_replace(parent, '^#', '') AS parent, relation FROM (SELECT play, xml_id, corresp AS parent, 'corresp' AS relation FROM cast_list UNION ALL SELECT play, xml_id, same_as, 'same_as' FROM cast_list) WHERE parent IS NOT NULL",
    "play_types": "SELECT play_type, count(*) AS n_plays FROM (SELECT play_name, max(nullif(lower(trim(play_type)), '')) AS play_type FROM play_types GROUP BY play_name) GROUP BY play_type",
    "mask_entities": f"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array({_masked('text')}, {_q(WHITE_SPACE)}), lambda x: x <> ''), ' ') AS text FROM documents",
    "pairs_aligned": f"WITH w AS (SELECT least(char1, char2) AS char1, greatest(char1, char2) AS char2, max(cosine_similarity_w2v) AS a FROM corpus_pairs WHERE {_GOOD} GROUP BY ALL), b AS (SELECT least(char1, char2) AS char1, greatest(char1, char2) AS char2, max(cosine_similarity_bert) AS b FROM corpus_pairs WHERE cosine_similarity_bert IS NOT NULL AND NOT isnan(cosine_similarity_bert) GROUP BY ALL) SELECT char1, char2, round(a, 6) AS a, round(b, 6) AS b FROM w JOIN b USING (char1, char2)",
    "shared_vocabulary": f"WITH v AS ({_VALID}) SELECT word, max(book) AS book FROM v WHERE word IS NOT NULL AND book IS NOT NULL GROUP BY word HAVING count(DISTINCT sp) = 2",
    "graph_node_books": "WITH b AS (SELECT word AS id, max(book) AS book FROM vectors WHERE book IS NOT NULL AND word IS NOT NULL GROUP BY word), k AS (SELECT book, (row_number() OVER (ORDER BY book) - 1)::INTEGER AS book_idx FROM (SELECT DISTINCT book FROM b)), n AS (SELECT char1 AS id FROM corpus_pairs UNION SELECT char2 FROM corpus_pairs) SELECT n.id, b.book, book_idx FROM n LEFT JOIN b USING (id) LEFT JOIN k USING (book) WHERE n.id IS NOT NULL",
    "entity_report": _with("aliases", "SELECT count(DISTINCT canonical) AS n_entities, string_agg(DISTINCT canonical, ', ' ORDER BY canonical) AS names FROM aliases"),
    "metric_compare_four": _COMPARE_FOUR,
    "book_matrix_dense": f"WITH g AS (SELECT char_book AS x, char2_book AS y, cosine_similarity_w2v AS value FROM corpus_pairs WHERE {_GOOD} AND char_book IS NOT NULL AND char2_book IS NOT NULL), p AS (SELECT least(x, y) AS a, greatest(x, y) AS b, avg(value) AS mean FROM g GROUP BY ALL), books AS (SELECT x AS book FROM g UNION SELECT y FROM g) SELECT i.book AS book_i, j.book AS book_j, round(coalesce(mean, 0.0), 6) AS mean FROM books i CROSS JOIN books j LEFT JOIN p ON a = least(i.book, j.book) AND b = greatest(i.book, j.book)",
    "w2v_pair_list": f"WITH v AS ({_VALID}), x AS (SELECT book, word, generate_subscripts(vec, 1) AS dim, unnest(vec)::DOUBLE AS x FROM v WHERE sp = 'w2v' AND book IS NOT NULL AND word IS NOT NULL), m AS (SELECT book, word, dim, avg(x) AS x FROM x GROUP BY ALL), e AS (SELECT book, word, list(x ORDER BY dim) AS vec FROM m GROUP BY ALL), p AS (SELECT a.word AS char1, b.word AS char2, round(list_cosine_similarity(a.vec, b.vec), 6) AS value FROM e a JOIN e b ON a.book = b.book AND a.word < b.word WHERE list_dot_product(a.vec, a.vec) > 0 AND list_dot_product(b.vec, b.vec) > 0) SELECT char1, char2, max(value) AS value FROM p GROUP BY ALL",
    "pairs_with_vectors": f"WITH v AS ({_VALID}) SELECT DISTINCT char1, char2 FROM corpus_pairs WHERE char1 IN (SELECT word FROM v WHERE sp = 'w2v' AND word IS NOT NULL) AND char2 IN (SELECT word FROM v WHERE sp = 'w2v' AND word IS NOT NULL)",
    "scatter_allowed": _FRAME + f" SELECT char1, char2, cooc, round(cosine, 5) AS cosine FROM frame WHERE char1 IN {ALLOWED} AND char2 IN {ALLOWED}",
    "mask_labels": f"WITH w AS (SELECT doc_id, {_words(_masked('text'))} AS w FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(list_filter(w, lambda x: length(x) = 6))::INTEGER AS n_kept, coalesce(list_sum(list_transform(CASE WHEN len(w) > 0 THEN w ELSE [''] END, lambda x: CASE WHEN length(x) = 6 THEN 6 ELSE -100 END)), 0)::BIGINT AS total FROM w",
    "cluster_ranks": "SELECT lang, (dense_rank() OVER (ORDER BY centre) - 1)::INTEGER AS cluster FROM (SELECT lower(substring(trim(lang), 1, 2)) AS lang, avg(length(text)) AS centre FROM documents WHERE lang IS NOT NULL AND text IS NOT NULL GROUP BY ALL)",
    "dbscan1d": """WITH v AS (SELECT play, n_tokens::DOUBLE AS v, count(*) AS n FROM hyperedges WHERE n_tokens IS NOT NULL GROUP BY ALL),
near AS (SELECT a.play, a.v, sum(b.n) AS near FROM v a JOIN v b ON a.play IS NOT DISTINCT FROM b.play AND abs(a.v - b.v) <= 3 GROUP BY ALL),
cores AS (SELECT play, v, (sum(opens) OVER (PARTITION BY play ORDER BY v) - 1)::INTEGER AS cluster FROM (SELECT play, v, (v - lag(v) OVER (PARTITION BY play ORDER BY v) <= 3) IS NOT TRUE AS opens FROM near WHERE near >= 4)),
labels AS (SELECT v.play, v.v, c.cluster FROM v LEFT JOIN cores c ON v.play IS NOT DISTINCT FROM c.play AND abs(v.v - c.v) <= 3 QUALIFY row_number() OVER (PARTITION BY v.play, v.v ORDER BY abs(v.v - c.v), c.v) = 1)
SELECT h.row_id, h.play, h.n_tokens, CASE WHEN h.n_tokens IS NOT NULL THEN coalesce(cluster, -1) END AS cluster FROM hyperedges h LEFT JOIN labels l ON h.play IS NOT DISTINCT FROM l.play AND h.n_tokens = l.v""",
    "greedy_chunks": f"""WITH w AS (SELECT doc_id AS book, {_words(_masked('text'))} AS w FROM documents WHERE text IS NOT NULL),
f AS (SELECT book, list_reduce(list_transform(CASE WHEN len(w) > 0 THEN w ELSE [''] END, lambda x: {{'done': []::VARCHAR[], 'open': [x], 'size': length(x)::BIGINT}}), lambda a, x: CASE WHEN a.size + x.size > 510 THEN {{'done': list_append(a.done, array_to_string(a.open, ' ')), 'open': x.open, 'size': x.size}} ELSE {{'done': a.done, 'open': list_concat(a.open, x.open), 'size': a.size + x.size}} END, {{'done': []::VARCHAR[], 'open': []::VARCHAR[], 'size': 0::BIGINT}}) AS f FROM w),
c AS (SELECT book, CASE WHEN len(f.open) > 0 THEN list_append(f.done, array_to_string(f.open, ' ')) ELSE f.done END AS c FROM f)
SELECT book, (generate_subscripts(c, 1) - 1)::INTEGER AS chunk_idx, unnest(c) AS text FROM c""",
    "first_subsequence": f"SELECT doc_id, coalesce(list_min(list_filter(range(1, len(w)), lambda i: w[i] = 'the' AND w[i + 1] = 'lantern')) - 1, 0)::INTEGER AS place FROM (SELECT doc_id, {_words('lower(text)')} AS w FROM documents WHERE text IS NOT NULL)",
    "tei_tags": r"SELECT record_id, (generate_subscripts(x, 1) - 1)::INTEGER AS idx, unnest(x) AS xml FROM (SELECT record_id, regexp_extract_all(regexp_replace(body, '(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>', '', 'g'), '(?s)<(?:\w+:)?speaker(?:\s[^>]*)?/>|<(?:\w+:)?speaker(?:\s[^>]*)?>.*?</(?:\w+:)?speaker\s*>') AS x FROM (SELECT record_id, CASE WHEN ltrim(body, chr(65279) || ' ' || chr(10)) LIKE '{%' AND json_valid(ltrim(body, chr(65279) || ' ' || chr(10))) THEN ltrim(body, chr(65279) || ' ' || chr(10))::JSON ->> 'payload' ELSE body END AS body FROM play_records))",
}
