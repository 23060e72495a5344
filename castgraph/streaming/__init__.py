"""Incremental use of the batch operators on streams of new files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from castgraph.operators.text import token_counts


def stream_table(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """A folder of parquet files as a stream with the schema of ``like``."""
    return spark.readStream.schema(like.schema).parquet(path)


def token_totals(stream: DataFrame, key: str, text: str) -> DataFrame:
    """Running totals of raw and cleaned tokens per key."""
    return token_counts(stream.select(F.col(key).alias("k"), F.col(text).alias("t")), "k", "t").groupBy(F.col("book").alias(key)).agg(F.sum("n_raw").alias("n_raw"), F.sum("n_clean").alias("n_clean"))
