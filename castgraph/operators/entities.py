"""Alias tables and the resolution of tokens to characters: O-02, O-03, O-18, O-19.

The two resolutions differ on purpose when aliases overlap: replacing tokens takes the first entity that lists the
alias, finding mentions the last.  Alias tables are small; Spark broadcasts them by their size, none is forced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def alias_rows(spark: SparkSession, lines: list[str]) -> DataFrame:
    """(ent_idx, canonical, alias_idx, alias) of lines of aliases, the first of each canonical; blank lines are skipped."""
    rows = []
    for idx, names in enumerate(x for x in (line.lower().split() for line in lines) if x):
        rows += [(idx, names[0], k, a) for k, a in enumerate(names)]
    return spark.createDataFrame(rows, "ent_idx int, canonical string, alias_idx int, alias string")


def first_match(aliases: DataFrame) -> DataFrame:
    """(alias, canonical): the lowest entity wins."""
    return aliases.groupBy("alias").agg(F.min_by("canonical", "ent_idx").alias("canonical"))


def last_match(aliases: DataFrame) -> DataFrame:
    """(alias, canonical): of entities with one canonical the last aliases count, at the first one's rank; then the last rank wins."""
    ranked = aliases.withColumn("rank", F.min("ent_idx").over(Window.partitionBy("canonical"))).withColumn("last", F.max("ent_idx").over(Window.partitionBy("canonical")))
    return ranked.filter("ent_idx = last").groupBy("alias").agg(F.max_by("canonical", "rank").alias("canonical"))


def canonicalize(tokens: DataFrame, aliases: DataFrame) -> DataFrame:
    """Every token that is an alias becomes its canonical name; others stay."""
    found = first_match(aliases)
    return tokens.join(found, tokens["token"] == found["alias"], "left").select("book", "pos", F.coalesce("canonical", "token").alias("token"))


def mentions(tokens: DataFrame, aliases: DataFrame, resolution: str = "last") -> DataFrame:
    """(book, pos, entity); resolution: last (default) or first."""
    found = last_match(aliases) if resolution == "last" else first_match(aliases)
    return tokens.join(found, tokens["token"] == found["alias"]).select("book", "pos", F.col("canonical").alias("entity"))
