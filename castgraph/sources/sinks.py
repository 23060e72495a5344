"""Writers: O-09..O-13. Each returns the path it wrote; folders of part files, as Spark writes them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLUSTERED = ("char1", "char2", "Co-Occurances", "Co-Occurances Cluster", "Cosine Similarity", "Cosine Similarity Cluster", "BERT - Entity Embedding Similarity", "BERT - Entity Embedding Cluster", "BERT - CLS Similarity", "BERT - CLS Similarity Cluster")


def write_differences(df: DataFrame, path: str) -> str:
    """Tab-separated Char1, Char2, Difference, rising."""
    df.select(F.col("char1").alias("Char1"), F.col("char2").alias("Char2"), F.col("difference").alias("Difference")).orderBy("Difference", "Char1", "Char2").write.mode("overwrite").csv(path, sep="\t", header=True)
    return path


def write_clustered(df: DataFrame, path: str) -> str:
    """The wide comparison of four metrics under its published column names."""
    df.toDF(*CLUSTERED).write.mode("overwrite").csv(path, sep="\t", header=True)
    return path


CORPUS = ("Char1", "Char2", "Cosine Similarity W2V", "Same Book", "Char Book", "Char2 Book", "Cosine Similarity BERT")


def write_corpus(df: DataFrame, path: str) -> str:
    """The corpus's pairs (char1, char2, w2v, same_book, char_book, char2_book, bert) under their column names, in order of the names."""
    df.select("char1", "char2", "w2v", "same_book", "char_book", "char2_book", "bert").orderBy("char1", "char2").toDF(*CORPUS).write.mode("overwrite").csv(path, header=True)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").csv(path, header=True)
    return path


def write_vectors_text(df: DataFrame, path: str, header: bool = False) -> str:
    """Lines of a word and its numbers; header: one file that begins with the number of words and of dimensions."""
    lines = df.select(F.lit(1).alias("k"), F.concat_ws(" ", F.col("word"), F.array_join(F.transform("vec", lambda x: x.cast("string")), " ")).alias("value"))
    if header:
        top = df.agg(F.lit(0).alias("k"), F.concat_ws(" ", F.count(F.lit(1)).cast("string"), F.coalesce(F.max(F.size("vec")), F.lit(0)).cast("string")).alias("value"))
        lines = top.unionByName(lines).coalesce(1).sortWithinPartitions("k", "value")
    lines.select("value").write.mode("overwrite").text(path)
    return path


def write_vectors_json(df: DataFrame, path: str, words: int = 50_000) -> str:
    """Lines {"vectors": {word: [numbers]}} of about ``words`` words each, as ``vector_json`` reads them."""
    parts = max(1, -(-df.count() // words))
    held = df.groupBy(F.pmod(F.xxhash64("word"), F.lit(parts)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("word", F.col("vec").cast("array<double>").alias("vec")))).alias("vectors"))
    held.select(F.to_json(F.struct("vectors")).alias("value")).write.mode("overwrite").text(path)
    return path


def entity_report(aliases: DataFrame) -> DataFrame:
    """(n_entities, names): the console report as a frame."""
    return aliases.agg(F.countDistinct("canonical").alias("n_entities"), F.array_join(F.sort_array(F.collect_set("canonical")), ", ").alias("names"))
