"""Column helpers used by the operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from castgraph.functions.shipping import is_local, ship_package


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """withColumn through a generator of one row: later filters and projections can't copy the expression into themselves."""
    return df.select(*(c for c in df.columns if c != name), F.explode(F.array(value)).alias(name))


def mapped(df: DataFrame, run: Callable, schema: object) -> DataFrame:
    """mapInArrow with this package at hand in the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows, written to the shared checkpoint folder (spark.checkpoint.dir); in local mode, as in tests, a folder of our own where none is set."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="castgraph-"))
    return df.checkpoint()
