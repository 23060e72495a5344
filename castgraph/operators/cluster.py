"""One-dimensional clusters of pair values: O-66, O-71, O-77, O-78."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castgraph.functions import checkpointed

MOST_DISTINCT = 20_000


def exact_kmeans_1d(values: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Optimal clusters of sorted distinct values with multiplicities: label of each value (by rising centre) and the centres.

    Dynamic programming over prefixes, divide and conquer per layer: O(k n log n).
    """
    n = len(values)
    if n == 1:
        return np.zeros(1, np.int64), np.array([0.9])
    k = min(k, n)
    w = np.concatenate([[0], np.cumsum(counts)])
    s = np.concatenate([[0], np.cumsum(counts * values)])
    q = np.concatenate([[0], np.cumsum(counts * values**2)])

    def cost(i, j):  # values i..j-1
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / (w[j] - w[i])

    best = np.array([0.0] + [cost(0, j) for j in range(1, n + 1)])
    backs = []
    for layer in range(2, k + 1):
        new, back = np.full(n + 1, np.inf), np.zeros(n + 1, np.int64)
        stack = [(layer, n, layer - 1, n - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid - 1) + 1)
            c = best[i] + cost(i, mid)
            j = int(c.argmin())
            new[mid], back[mid] = c[j], i[j]
            stack += [(lo, mid - 1, a, back[mid]), (mid + 1, hi, back[mid], b)]
        best, backs = new, [*backs, back]
    label, centres, j = np.zeros(n, np.int64), np.zeros(k), n
    for layer in range(k, 0, -1):
        i = int(backs[layer - 2][j]) if layer > 1 else 0
        label[i:j], centres[layer - 1] = layer - 1, (s[j] - s[i]) / (w[j] - w[i])
        j = i
    return label, centres


def _relaxed(w: np.ndarray, s: np.ndarray, q: np.ndarray, inner: np.ndarray, may: np.ndarray, k: int) -> list[np.ndarray]:
    """Least cost of each prefix of ranges in 1..k clusters where a cut inside a range (one with ``may``) leaves that range out: never above the true cost."""
    n = len(w)
    w, s, q, e = (np.concatenate([[0], np.cumsum(x)]) for x in (w, s, q, inner))

    def cost(i, j):  # ranges i..j-1
        return q[j] - q[i] - (s[j] - s[i]) ** 2 / np.maximum(w[j] - w[i], 1) + e[j] - e[i]

    out = [cost(np.zeros(n + 1, np.int64), np.arange(n + 1))]
    for _ in range(k - 1):
        left = out[-1].copy()
        left[1:] = np.where(may, np.minimum(left[1:], out[-1][:-1]), left[1:])
        new = np.zeros(n + 1)
        stack = [(0, n, 0, n)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            mid = (lo + hi) // 2
            i = np.arange(a, min(b, mid) + 1)
            c = left[i] + cost(i, mid)
            at = int(c.argmin())
            new[mid] = c[at]
            stack += [(lo, mid - 1, a, i[at]), (mid + 1, hi, i[at], b)]
        out.append(new)
    return out


def _open(t: pd.DataFrame, k: int) -> np.ndarray:
    """Which ranges may hold a cut of the best clusters: those where the least cost of a cut inside isn't above that of the best cuts between ranges."""
    mean = t.s / t.w
    inner = np.maximum(t.q - t.s * mean, 0).to_numpy()
    w, m, may = t.w.to_numpy(float), mean.to_numpy(), (t.d > 1).to_numpy()
    label, centres = exact_kmeans_1d(m, w, k)
    most = (w * (m - centres[label]) ** 2).sum() + inner.sum()
    ahead = _relaxed(w, w * m, w * m * m, inner, may, k)
    behind = _relaxed(*(x[::-1] for x in (w, w * m, w * m * m, inner, may)), k)
    least = np.min([ahead[i][:-1] + behind[k - 2 - i][::-1][1:] for i in range(k - 1)], axis=0)
    return may & (least <= most * (1 + 1e-9) + 1e-12 * t.q.sum())


def _refined(distinct: DataFrame, k: int) -> pd.DataFrame:
    """Ranges of the distinct values (v: mean, n, hi: greatest value) of which none can hold a cut inside, so that the best clusters of the ranges are those of the values."""
    distinct = checkpointed(distinct)
    middle = distinct.agg(F.sum(F.col("v") * F.col("n")) / F.sum("n")).first()[0]
    x = F.col("v") - middle

    def gathered(rows: DataFrame) -> pd.DataFrame:
        return rows.groupBy("b").agg(F.sum("n").alias("w"), F.sum(x * F.col("n")).alias("s"), F.sum(x * x * F.col("n")).alias("q"), F.count(F.lit(1)).alias("d"), F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas()

    def numbered(rows: DataFrame, bounds: np.ndarray, wanted: np.ndarray | None = None) -> DataFrame:
        def number(v: pd.Series) -> pd.Series:
            b = np.searchsorted(bounds, v, side="left")
            return pd.Series(b if wanted is None else np.where(wanted[np.minimum(b, len(wanted) - 1)], b, -1))

        return rows.withColumn("b", F.pandas_udf(number, "long")("v")).filter("b >= 0")

    bounds = np.unique(distinct.approxQuantile("v", np.linspace(0, 1, MOST_DISTINCT + 1)[1:-1].tolist(), 0.1 / MOST_DISTINCT))
    t = gathered(numbered(distinct, bounds)).sort_values("lo", ignore_index=True)
    while k > 1 and (wanted := _open(t, k)).any():
        inside = numbered(distinct, t.hi.to_numpy(), wanted)
        if t.d[wanted].sum() <= MOST_DISTINCT:
            new = inside.select((F.col("n")).alias("w"), (x * F.col("n")).alias("s"), (x * x * F.col("n")).alias("q"), F.lit(1).alias("d"), F.col("v").alias("lo"), F.col("v").alias("hi")).toPandas()
        else:
            parts = max(2, MOST_DISTINCT // int(wanted.sum()))
            shares = F.array(*(F.lit(float(y)) for y in np.linspace(0, 1, parts + 1)[1:-1]))
            cuts = inside.groupBy("b").agg(F.percentile_approx("v", shares, 10 * parts).alias("cuts"), F.min("v").alias("lo"), F.max("v").alias("hi")).toPandas()
            within = [[y for y in c if y < hi] or [lo] for c, lo, hi in zip(cuts.cuts, cuts.lo, cuts.hi, strict=True)]
            new = gathered(numbered(inside.drop("b"), np.unique(np.concatenate([*within, cuts.hi.to_numpy()]))))
        t = pd.concat([t[~wanted], new]).sort_values("lo", ignore_index=True)
    return pd.DataFrame({"v": t.s / t.w, "n": t.w, "hi": t.hi})


def cluster_values(pairs: DataFrame, k: int = 5, value: str = "value") -> DataFrame:
    """Adds ``cluster``, the rank of the value's cluster by rising centre.

    Works on the distinct values with their counts, so repeated values cost nothing. Above MOST_DISTINCT distinct values they are
    gathered into ranges, and those that can hold a limit of a cluster are refined down to single values: the result is exact at every size.
    """
    pairs = checkpointed(pairs)  # read for the distinct values and again for the labels
    rows = pairs.filter(F.col(value).isNotNull())
    distinct = rows.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    head = distinct.limit(MOST_DISTINCT + 1).toPandas()
    if head.empty:
        return pairs.withColumn("cluster", F.lit(None).cast("int"))
    summary = _refined(distinct, k) if len(head) > MOST_DISTINCT else head.sort_values("v", ignore_index=True).assign(hi=lambda t: t.v)
    label, _ = exact_kmeans_1d(summary.v.to_numpy(float), summary.n.to_numpy(float), k)
    first = np.flatnonzero(np.diff(label, prepend=-1))
    cluster = F.lit(0)
    for i in first[1:]:
        cluster = cluster + (F.col(value).cast("double") > float(summary.hi[i - 1])).cast("int")
    return pairs.withColumn("cluster", F.when(F.col(value).isNotNull(), cluster))


def rank_labels(df: DataFrame, centre: str = "centre") -> DataFrame:
    """Relabels clusters by rising centre, from 0; df: one row per cluster."""
    return df.withColumn("cluster", F.dense_rank().over(Window.partitionBy(F.lit(0)).orderBy(centre)) - 1)


def dbscan_1d(df: DataFrame, value: str, eps: float, min_samples: int, group: list[str] | None = None) -> DataFrame:
    """Adds ``cluster`` (-1 for noise): a core value has ``min_samples`` values within eps (itself included); cores closer than eps chain; others join the nearest core within eps (ties: the lower).

    Runs on the distinct values of a group, with counts.
    """
    group = group or []
    by = [*group] or [F.lit(0)]
    v = df.filter(F.col(value).isNotNull()).groupBy(*group, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    keys = ", ".join(f"`{g}`" for g in group) or "0"
    near = f"sum(n) OVER (PARTITION BY {keys} ORDER BY v RANGE BETWEEN CAST({eps} AS DOUBLE) PRECEDING AND CAST({eps} AS DOUBLE) FOLLOWING)"
    v = v.withColumn("near", F.expr(near)).withColumn("core", F.col("near") >= min_samples)
    w = Window.partitionBy(*by).orderBy("v")
    core_v = F.when(F.col("core"), F.col("v"))
    before = F.last(core_v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first(core_v, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    v = v.withColumn("before", before).withColumn("after", after)
    v = v.withColumn("opens", (F.col("core") & (F.col("before").isNull() | (F.col("v") - F.col("before") > eps))).cast("int"))
    v = v.withColumn("number", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1)
    low = (F.col("before").isNotNull() & (F.col("v") - F.col("before") <= eps))
    high = (F.col("after").isNotNull() & (F.col("after") - F.col("v") <= eps))
    up = high & (~low | (F.col("after") - F.col("v") < F.col("v") - F.col("before")))
    next_number = F.col("number") + F.when(low & (F.col("after") - F.col("before") <= eps), 0).otherwise(1)
    cluster = F.when(F.col("core"), F.col("number")).when(up, next_number).when(low, F.col("number")).otherwise(-1)
    labelled = v.select(*(F.col(g).alias(f"_g{i}") for i, g in enumerate(group)), F.col("v").alias("_v"), cluster.cast("int").alias("_cluster"))
    on = F.col(value).cast("double") == F.col("_v")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return df.drop("cluster").join(labelled, on, "left").select(*(c for c in df.columns if c != "cluster"), F.col("_cluster").alias("cluster"))
