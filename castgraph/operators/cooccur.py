"""Windowed co-occurrence: O-31, O-59, O-20.

Two mentions of different entities less than ``window`` positions apart count once, per pair of mentions.  The range join is
an equi-join on blocks of ``window`` positions: the later mention of a pair lies in the same block or the next, so the right side is
listed for its own block and the one before. A book of any length is spread over its blocks, so no task holds a whole book.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cooccurrences(mentions: DataFrame, window: int = 15) -> DataFrame:
    """(book, char1, char2, count, first_left, first_right), char1 < char2; the last two are the first encounter."""
    block = (F.col("pos") / window).cast("bigint")
    left = mentions.select("book", F.col("pos").alias("p1"), F.col("entity").alias("e1"), block.alias("block"))
    right = mentions.select("book", F.col("pos").alias("p2"), F.col("entity").alias("e2"), F.explode(F.array(block, block - 1)).alias("block"))
    near = (F.col("p2") > F.col("p1")) & (F.col("p2") - F.col("p1") < window) & (F.col("e1") != F.col("e2"))
    met = left.join(right, ["book", "block"]).filter(near)
    first = F.min(F.struct("p1", "p2"))
    out = met.groupBy("book", F.least("e1", "e2").alias("char1"), F.greatest("e1", "e2").alias("char2")).agg(F.count(F.lit(1)).alias("count"), first.alias("first"))
    return out.select("book", "char1", "char2", "count", F.col("first.p1").alias("first_left"), F.col("first.p2").alias("first_right"))


def corpus_counts(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("char1", "char2").agg(F.sum("count").alias("count"))
