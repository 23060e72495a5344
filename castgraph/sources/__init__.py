"""Readers of the project's tables and of text, alias, TEI, vector and hypergraph files."""

from __future__ import annotations

import warnings

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_books(spark: SparkSession, path: str) -> DataFrame:
    """(book, text) of whole files; the book is the file's name without its ending."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.regexp_extract("_metadata.file_name", r"^(.*?)(\.[^.]*)?$", 1).alias("book"), F.col("value").alias("text"))


def alias_lines(spark: SparkSession, path: str, lower: bool = True) -> DataFrame:
    """(book, ent_idx, canonical, aliases) of ragged alias files; blank lines are skipped; book is the folder's name."""
    raw = spark.read.text(path, wholetext=True)
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    lines = raw.select(folder.alias("book"), F.split((F.lower("value") if lower else F.col("value")), r"\r\n|\n|\r").alias("lines"))
    names = F.filter(F.transform("lines", lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")), lambda ws: F.size(ws) > 0)
    return lines.select("book", F.posexplode(names).alias("ent_idx", "aliases")).select("book", "ent_idx", F.col("aliases")[0].alias("canonical"), "aliases")


def flat_names(spark: SparkSession, path: str) -> DataFrame:
    """(name) of all names of alias files, case kept; a missing file gives an empty list and a warning."""
    try:
        return alias_lines(spark, path, lower=False).select("ent_idx", F.posexplode("aliases").alias("k", "name")).select("name")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        warnings.warn(f"no alias file at {path}", stacklevel=2)
        return spark.createDataFrame([], "name string")


def corpus_folder(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Texts and aliases of a folder of books: <book>/<book>.txt and <book>/Entities."""
    return text_books(spark, f"{root}/*/*.txt"), alias_lines(spark, f"{root}/*/Entities")


def tei_plays(spark: SparkSession, path: str) -> DataFrame:
    """(play, body) of TEI files."""
    return text_books(spark, path).select(F.col("book").alias("play"), F.col("text").alias("body"))


def vector_lines(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of word2vec text files; the header line is skipped."""
    parts = spark.read.text(path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.size("p") > 2)
    return parts.select(F.col("p")[0].alias("word"), F.transform(F.slice("p", F.lit(2), F.size("p") - 1), lambda x: x.cast("double")).alias("vec"))


def vector_json(spark: SparkSession, path: str) -> DataFrame:
    """(word, vec) of {"vectors": {word: [..]}} files: one object a file, or one a line."""
    kind = "struct<vectors:map<string,array<double>>>"
    whole = spark.read.text(path, wholetext=True).select("value", F.from_json("value", kind).alias("j"))
    lines = whole.filter("j.vectors IS NULL OR rlike(trim(value), '[}][\\\\r\\\\n]+[{]')").select(F.explode(F.split("value", "[\r\n]+")).alias("value")).select(F.from_json("value", kind).alias("j"))
    one = whole.filter("j.vectors IS NOT NULL AND NOT rlike(trim(value), '[}][\\\\r\\\\n]+[{]')").select("j")
    return one.unionByName(lines).select(F.explode("j.vectors").alias("word", "vec"))


HYPERGRAPH = {
    "scene_edges": "act int, scene int, n_tokens int, n_lines int, onstage string",
    "group_edges": "act int, scene int, stagegroup int, n_tokens int, n_lines int, onstage string",
    "node_weights": "act int, scene int, node string, n_tokens_speaker int, n_lines_speaker int, n_tokens_onstage int, n_lines_onstage int",
    "node_totals": "node string, n_tokens_onstage int, n_tokens_speaker int, n_lines_onstage int, n_lines_speaker int",
    "clique_edges": "node1 string, node2 string, count int",
    "star_edges": "node1 string, node2 string, n_lines int, n_tokens int",
    "nodes": "node string, node_type string",
    "play_types": "play_name string, play_type string",
}


def hypergraph_csv(spark: SparkSession, path: str, layout: str) -> DataFrame:
    """A hypergraph file of one of the known layouts, with the play from the file's name; lines that begin with # are comments in play types."""
    reader = spark.read.schema(HYPERGRAPH[layout]).option("header", True)
    if layout == "play_types":
        return reader.option("comment", "#").csv(path)
    return reader.csv(path).withColumn("play", F.regexp_extract("_metadata.file_name", r"^(.*?)_", 1))


def cast_csv(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cast lists with or without the sameAs column."""
    from functools import reduce

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (spark.read.option("header", True).csv(p) for p in paths))
