"""Vectors: means, cosines, pair lists, principal components: O-28, O-32..O-37, O-54, O-60, O-67.

Sums run over ``zip_with`` in the JVM. Means explode by dimension into a partial hash aggregate, so a hot entity is combined
map-side.  All-pairs lists are for entity lists (tens of names per group); a row number joins i < j inside a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column, zero_norm: float | None = None) -> Column:
    """Cosine similarity; a zero vector gives ``zero_norm`` (null by default)."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(zero_norm).cast("double"))


def mean_long(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, dim, avg): mean of each dimension."""
    return df.select(*keys, F.posexplode(vec).alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("avg"))


def mean_vectors(df: DataFrame, keys: list[str], vec: str) -> DataFrame:
    """(keys, vec): mean vector of each key."""
    parts = mean_long(df, keys, vec).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("dim", "avg"))).alias("parts"))
    return parts.select(*keys, F.transform("parts", lambda p: p["avg"]).alias("vec"))


def all_pairs(entities: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """Triangular pairs of an entity list: columns name1, vec1, idx1, name2, vec2, idx2."""
    group = group or []
    numbered = entities.withColumn("idx", F.row_number().over(Window.partitionBy(*group).orderBy(*order)) if group else F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    side = lambda k: numbered.select(*group, F.col("name").alias(f"name{k}"), F.col("vec").alias(f"vec{k}"), F.col("idx").alias(f"idx{k}"))
    if group:
        return side(1).join(side(2), group).filter("idx1 < idx2")
    return side(1).join(side(2), F.col("idx1") < F.col("idx2"))


def pair_similarities(entities: DataFrame, order: list[str], group: list[str] | None = None) -> DataFrame:
    """(group..., char1, char2, value, idx1, idx2) of all pairs with vectors."""
    return all_pairs(entities.filter(F.col("vec").isNotNull()), order, group).select(*(group or []), F.col("name1").alias("char1"), F.col("name2").alias("char2"), cosine(F.col("vec1"), F.col("vec2")).alias("value"), "idx1", "idx2")


def dedup_pairs(pairs: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row per unordered pair, the greatest value first (ties: the earlier pair); self pairs stay."""
    best = F.max_by(F.struct("char1", "char2", "value"), F.struct("value", -F.col("idx1"), -F.col("idx2")))
    keys = [*(group or []), F.least("char1", "char2").alias("k1"), F.greatest("char1", "char2").alias("k2")]
    return pairs.groupBy(*keys).agg(best.alias("b")).select(*(group or []), "b.char1", "b.char2", "b.value")


def principal_components(df: DataFrame, vec: str, k: int, keep: list[str]) -> tuple[DataFrame, np.ndarray]:
    """(keep, pc array) and the explained variance ratios: centred PCA, signs fixed so that each loading of largest size is positive.

    The covariance is summed distributedly (Spark ML); only the dim x dim loadings reach the driver.
    """
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.filter(F.col(vec).isNotNull()).select(*keep, array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    scaler = StandardScaler(withMean=True, withStd=False, inputCol="v", outputCol="c").fit(rows)
    model = PCA(k=k, inputCol="c", outputCol="p").fit(scaler.transform(rows))
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(0), np.arange(k)])
    flip = F.array(*(F.lit(float(s)) for s in signs))
    out = model.transform(scaler.transform(rows)).select(*keep, F.zip_with(vector_to_array("p"), flip, lambda a, b: a * b).alias("pc"))
    return out, model.explainedVariance.toArray()
