"""Unordered-pair algebra: O-38..O-44, O-48..O-53, O-55..O-57, O-61..O-64.

Pairs meet by (least, greatest), an equi-join key, so each comparison is a hash join or one hash aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key() -> list[Column]:
    return [F.least("char1", "char2").alias("k1"), F.greatest("char1", "char2").alias("k2")]


def difference(left: DataFrame, right: DataFrame, group: list[str] | None = None, normalise: bool = True) -> DataFrame:
    """(group..., char1, char2, difference): left's value, divided by its greatest if ``normalise``, minus right's; orientation from the left."""
    group = group or []
    if normalise:
        top = left.groupBy(*group).agg(F.max("value").alias("top"))
        left = (left.join(top, group) if group else left.crossJoin(F.broadcast(top))).withColumn("value", F.col("value") / F.col("top"))  # without a group the right side is one row
    a = left.select(*group, "char1", "char2", F.col("value").alias("a"), *_key())
    b = right.select(*group, F.col("value").alias("b"), *_key())
    return a.join(b, [*group, "k1", "k2"]).select(*group, "char1", "char2", (F.col("a") - F.col("b")).alias("difference"))


def compare_wide(metrics: dict[str, DataFrame]) -> DataFrame:
    """One row per unordered pair with each metric's value and cluster; missing ones are 0 and cluster 0.  Orientation: the first metric's that has the pair.

    metrics: name -> (char1, char2, value[, cluster]), in order.
    """
    long = None
    for n, (name, df) in enumerate(metrics.items()):
        part = df.select(*_key(), "char1", "char2", F.col("value").cast("double").alias("value"), (F.col("cluster") if "cluster" in df.columns else F.lit(0)).cast("int").alias("cluster"), F.lit(n).alias("n"), F.lit(name).alias("metric"))
        long = part if long is None else long.unionByName(part)
    aggs = []
    for n, name in enumerate(metrics):
        mine = F.col("n") == n
        aggs += [F.coalesce(F.max(F.when(mine, F.col("value"))), F.lit(0.0)).alias(name), F.coalesce(F.max(F.when(mine, F.col("cluster"))), F.lit(0)).alias(f"{name}_cluster")]
    first = F.min_by(F.struct("char1", "char2"), F.struct("n", "value", "char1", "char2")).alias("o")
    return long.groupBy("k1", "k2").agg(first, *aggs).select("o.char1", "o.char2", *(c for name in metrics for c in (name, f"{name}_cluster")))


def aligned(left: DataFrame, right: DataFrame) -> DataFrame:
    """(char1, char2, a, b): pairs of both lists; of repeats within a list the greatest value."""
    a = left.groupBy(*_key()).agg(F.max("value").alias("a"))
    b = right.groupBy(*_key()).agg(F.max("value").alias("b"))
    return a.join(b, ["k1", "k2"]).select(F.col("k1").alias("char1"), F.col("k2").alias("char2"), "a", "b")


def same_book(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Adds same_book: 1 iff some book lists both; lists: (book, name)."""
    names = lists.distinct()
    wanted = pairs.select("char1", "char2").distinct()
    both = wanted.join(names.select(F.col("name").alias("char1"), "book"), "char1").join(names.select(F.col("name").alias("char2"), "book"), ["char2", "book"], "left_semi").select("char1", "char2").distinct().withColumn("hit", F.lit(1))
    return pairs.join(both, ["char1", "char2"], "left").withColumn("same_book", F.coalesce("hit", F.lit(0))).drop("hit")


def entity_book(lists: DataFrame) -> DataFrame:
    """(name, book): the last book that lists a name."""
    return lists.groupBy("name").agg(F.max("book").alias("book"))


def book_matrix(pairs: DataFrame, dense: bool = True) -> DataFrame:
    """(book_i, book_j, mean): mean value of the pairs between two books, both orders; if ``dense``, books without pairs have 0 (books x books rows)."""
    key = [F.least("book1", "book2").alias("a"), F.greatest("book1", "book2").alias("b")]
    mean = pairs.groupBy(*key).agg(F.avg("value").alias("mean"))
    both = mean.select(F.col("a").alias("book_i"), F.col("b").alias("book_j"), "mean").unionByName(mean.filter("a <> b").select(F.col("b").alias("book_i"), F.col("a").alias("book_j"), "mean"))
    if not dense:
        return both
    books = pairs.select(F.explode(F.array("book1", "book2")).alias("book")).filter("book IS NOT NULL").distinct()
    spine = books.withColumnRenamed("book", "book_i").crossJoin(books.withColumnRenamed("book", "book_j"))  # the dense matrix is the result asked for
    return spine.join(both, ["book_i", "book_j"], "left").select("book_i", "book_j", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def heat_map(pairs: DataFrame) -> DataFrame:
    """(row, col, value) of the dense symmetric matrix M + M^T over all labels; self pairs double."""
    sided = pairs.select(F.col("char1").alias("row"), F.col("char2").alias("col"), "value").unionByName(pairs.select(F.col("char2").alias("row"), F.col("char1").alias("col"), "value"))
    cells = sided.groupBy("row", "col").agg(F.sum("value").alias("value"))
    labels = sided.select(F.col("row").alias("label")).distinct()
    spine = labels.withColumnRenamed("label", "row").crossJoin(labels.withColumnRenamed("label", "col"))  # labels of one matrix
    return spine.join(cells, ["row", "col"], "left").select("row", "col", F.coalesce("value", F.lit(0).cast(cells.schema["value"].dataType)).alias("value"))


def graph(pairs: DataFrame, metric: str = "cooc", order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """vertices (id), edges (src, dst, weight): 1/value for co-occurrence, value - 1 for contextual cosine, else the value.

    Of repeated edges, either way round, the last by ``order`` stays (ties and without ``order``: the greatest value).
    """
    weight = {"cooc": F.lit(1.0) / F.col("value"), "bert": F.col("value") - 1.0}.get(metric, F.col("value"))
    vertices = pairs.select(F.explode(F.array("char1", "char2")).alias("id")).distinct()
    last = F.struct(*([order] if order else []), "value", "char1", "char2")
    one = pairs.groupBy(*_key()).agg(F.max_by(F.struct("char1", "char2", "value"), last).alias("e")).select("e.*")
    return vertices, one.select(F.col("char1").alias("src"), F.col("char2").alias("dst"), weight.alias("weight"))


def node_groups(vertices: DataFrame, books: DataFrame) -> DataFrame:
    """Adds book_idx, the place of the vertex's book in the sorted book list, from 0."""
    numbers = books.select("book").distinct().withColumn("book_idx", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy("book")) - 1)
    return vertices.join(books.withColumnRenamed("name", "id"), "id", "left").join(numbers, "book", "left").select("id", "book", "book_idx")


def spring_layout(vertices: DataFrame, edges: DataFrame, seed: int = 42, steps: int = 50, scale: float = 10.0, most: int = 5000) -> DataFrame:
    """(id, x, y) by the force-directed method, on the driver: for graphs to be drawn, up to ``most`` vertices."""
    import numpy as np

    spark = vertices.sparkSession
    ids = [r[0] for r in vertices.orderBy("id").limit(most + 1).collect()]
    if len(ids) > most:
        raise ValueError(f"a layout is for drawing; this graph has more than {most} vertices")
    place = {v: i for i, v in enumerate(ids)}
    n = len(ids)
    if not n:
        return spark.createDataFrame([], "id string, x double, y double")
    a = np.zeros((n, n))
    for s, t, w in edges.select("src", "dst", "weight").toLocalIterator():
        a[place[s], place[t]] = a[place[t], place[s]] = abs(w or 0.0)
    pos = np.random.default_rng(seed).random((n, 2))
    k, heat = np.sqrt(1 / n), 0.1
    for step in range(steps):
        d = pos[:, None] - pos[None]
        dist = np.maximum(np.linalg.norm(d, axis=2), 0.01)
        move = (d * (k * k / dist**2 - a * dist / k)[:, :, None]).sum(1)
        length = np.maximum(np.linalg.norm(move, axis=1), 0.01)
        pos += move * (heat * (1 - step / steps) / length)[:, None]
    pos -= pos.mean(0)
    pos *= scale / max(np.abs(pos).max(), 1e-12)
    return spark.createDataFrame([(v, float(x), float(y)) for v, (x, y) in zip(ids, pos, strict=True)], "id string, x double, y double")


def scatter_frame(characters: DataFrame, cooc: DataFrame, cosines: DataFrame) -> DataFrame:
    """(char1, char2, cooc, cosine) of every pair of a character list (idx, name), zeros included."""
    side = lambda k: characters.select(F.col("name").alias(f"char{k}"), F.col("idx").alias(f"i{k}"))
    spine = side(1).join(side(2), F.col("i1") < F.col("i2")).select("char1", "char2", *_key())  # the character list of a play
    keyed = lambda df, name: df.select(*_key(), F.col("value").alias(name))
    out = spine.join(keyed(cooc, "cooc"), ["k1", "k2"], "left").join(keyed(cosines, "cosine"), ["k1", "k2"], "left")
    return out.select("char1", "char2", F.coalesce(F.col("cooc").cast("double"), F.lit(0.0)).alias("cooc"), F.coalesce("cosine", F.lit(0.0)).alias("cosine"))


def trend(frame: DataFrame) -> DataFrame:
    return frame.agg(F.regr_slope("cosine", "cooc").alias("slope"), F.regr_intercept("cosine", "cooc").alias("intercept"))


def difference_bars(frame: DataFrame) -> DataFrame:
    """(label, difference, shade): shade is the difference scaled to 0..1."""
    d = frame.select(F.concat_ws("-", "char1", "char2").alias("label"), (F.col("cooc") - F.col("cosine")).alias("difference"))
    span = d.agg(F.min("difference").alias("lo"), F.max("difference").alias("hi"))
    return d.crossJoin(F.broadcast(span)).select("label", "difference", F.when(F.col("hi") > F.col("lo"), (F.col("difference") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("shade"))  # the right side is one row
