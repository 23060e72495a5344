"""Items that appear together: exact pair counts and how surprising they are.

Counts.  The baskets of a group become sorted sets; equal sets of a group are counted once with their multiplicity,
so repeated baskets cost nothing in the pair step.  A set is unrolled item by item, so no row ever holds all pairs of
a basket; a set of more than BLOCK items is cut into blocks, and pairs of blocks are spread over the tasks.  Pairs are summed map-side before their shuffle.

Null model.  Per group a bipartite configuration model is fitted: basket e holds item i with probability
x_i y_e / (1 + x_i y_e), the fitnesses chosen so that every item's expected frequency and every basket's expected size
equal the observed ones.  Items of equal frequency share x and baskets of equal size share y, so the fit works on two
histograms per group, never on the baskets.  Where a histogram has more than KINDS values, neighbouring ones are joined for the fit of the other
side's fitness; each value's own fitness is then solved exactly against it, so memory stays bounded.

Surprise.  Under the null a pair's count is Poisson-binomial: a sum of binomials over the basket sizes.  Its upper tail
comes from the lattice saddle-point formula (relative error below a few per cent into the far tail, checked against the
exact convolution in the tests).  The tail depends on both frequencies and the count only, so it is computed once per such triple of a
group.  Benjamini-Hochberg q-values are per group over all pairs of its items, those that never
met included; ranks run over distinct p-values, range-partitioned, so neither a group nor a stretch of p-values is sorted in one task.

Defined results: a null group, basket or item takes no part; a basket is a set, repeated rows don't count; ties in the
p-value share their q-value; an empty input gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from castgraph.functions import checkpointed, mapped

MAX_ITERATIONS, TOLERANCE = 2000, 1e-10
BLOCK = 1000  # items of a basket unrolled against as many
KINDS = 512  # values of a histogram in the joint fit
CELLS = 1 << 18  # numbers of a matrix held at once
CHUNK = 4096  # about as many triples share one copy of their group's histograms


# -- the null model, on histograms ------------------------------------------------------------------------------


def fit_bicm(degree: np.ndarray, n_items: np.ndarray, size: np.ndarray, n_baskets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fitness of each item degree and each basket size; infinite for an item in all baskets or a basket of all items."""
    x, y = np.full(len(degree), np.inf), np.full(len(size), np.inf)
    di, ds = degree.astype(float), size.astype(float)
    live_i, live_s = np.ones(len(degree), bool), np.ones(len(size), bool)
    while True:  # what is full has probability 1 everywhere; it is taken out until nothing is full
        full_i = live_i & (di >= n_baskets[live_s].sum())
        ds = ds - n_items[full_i].sum() * live_s
        live_i &= ~full_i
        full_s = live_s & (ds >= n_items[live_i].sum())
        di = di - n_baskets[full_s].sum() * live_i
        live_s &= ~full_s
        if not full_i.any() and not full_s.any():
            break
    x[live_i & (di <= 0)] = 0
    y[live_s & (ds <= 0)] = 0
    live_i &= di > 0
    live_s &= ds > 0
    if not live_i.any() or not live_s.any():
        return x, y
    d, s, ni, ns = di[live_i], ds[live_s], n_items[live_i].astype(float), n_baskets[live_s].astype(float)
    d_few, ni_few = _joined(d, ni)
    s_few, ns_few = _joined(s, ns)
    a, b = _fixed_point(d_few, ni_few, s_few, ns_few)
    x[live_i] = a if len(a) == len(d) else _solve(d, b, ns_few, np.interp(d, d_few, a))
    y[live_s] = b if len(b) == len(s) else _solve(s, a, ni_few, np.interp(s, s_few, b))
    return x, y


def _joined(v: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A histogram of rising values with at most KINDS of them: neighbours on a logarithmic scale become their mean."""
    if len(v) <= KINDS:
        return v, n
    k = np.unique(np.floor((KINDS - 1) * np.log(v / v[0]) / max(np.log(v[-1] / v[0]), 1e-12)).astype(np.int64), return_inverse=True)[1]
    total = np.bincount(k, n)
    return np.bincount(k, n * v) / total, total


def _fixed_point(d: np.ndarray, ni: np.ndarray, s: np.ndarray, ns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fitnesses a of d and b of s: both sides in turn, with a jump along the last two steps (squared extrapolation) every third time."""
    root = np.sqrt(max((d * ni).sum(), 1e-9))

    def step(a, b):
        a = d / (ns * b / (1 + a[:, None] * b)).sum(1)
        return a, s / (ni * a / (1 + b[:, None] * a)).sum(1)

    a, b = d / root, s / root
    for _ in range(MAX_ITERATIONS // 3):
        a1, b1 = step(a, b)
        if max(np.abs(a1 / a - 1).max(), np.abs(b1 / b - 1).max()) < TOLERANCE:
            return a1, b1
        a2, b2 = step(a1, b1)
        one, two = np.log(np.concatenate([a1 / a, b1 / b])), np.log(np.concatenate([a2 / a1, b2 / b1]))
        bend = np.linalg.norm(two - one)
        far = np.clip(np.linalg.norm(one) / bend if bend > 0 else 1.0, 1.0, 64.0)
        jump = np.clip(2 * far * one + far * far * (two - one), -3, 3)
        a, b = step(a * np.exp(jump[: len(a)]), b * np.exp(jump[len(a) :]))
    return a, b


def _solve(d: np.ndarray, b: np.ndarray, ns: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Each d's own fitness against fitnesses b held ns times, by Newton steps on its logarithm, a block of d at a time."""
    out = start.copy()
    rows = max(1, CELLS // len(b))
    for k in range(0, len(d), rows):
        z = np.log(out[k : k + rows])
        for _ in range(30):
            p = np.exp(z)[:, None] * b
            p = p / (1 + p)
            move = ((ns * p).sum(1) - d[k : k + rows]) / np.maximum((ns * p * (1 - p)).sum(1), 1e-300)
            z = z - np.clip(move, -2, 2)
            if np.abs(move).max() < TOLERANCE:
                break
        out[k : k + rows] = np.exp(z)
    return out


def probability(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The chance that a basket holds an item; a zero fitness wins over an infinite one."""
    with np.errstate(invalid="ignore", over="ignore"):
        xy = x * y
        p = xy / (1 + xy)
    p = np.where(np.isinf(x) | np.isinf(y), 1.0, p)
    return np.where((x == 0) | (y == 0), 0.0, p)


def upper_tail(k: np.ndarray, q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """P(X >= k) of X, the sum over classes s of Binomial(m_s, q_s); q: rows x classes."""
    from math import erfc

    k, m = np.asarray(k, float), np.asarray(m, float)
    mean, sure = (q * m).sum(1), ((q >= 1) * m).sum(1)
    top = ((q > 0) * m).sum(1)
    out = np.ones(len(k))
    inner = (k > sure) & (k < top) & (k > 0)
    out[k > top] = 0.0
    edge = (k == top) & (k > sure)
    if edge.any():
        with np.errstate(divide="ignore"):
            out[edge] = np.exp((np.where(q[edge] > 0, np.log(np.where(q[edge] > 0, q[edge], 1)), 0) * m).sum(1))
    if inner.any():
        q_, k_ = q[inner], k[inner]
        t = np.zeros(len(k_))
        lo, hi = np.full(len(k_), -60.0), np.full(len(k_), 60.0)
        for _ in range(200):
            e = q_ * np.exp(t)[:, None]
            r = e / (1 - q_ + e)
            d1, d2 = (m * r).sum(1) - k_, (m * r * (1 - r)).sum(1)
            lo, hi = np.where(d1 < 0, t, lo), np.where(d1 > 0, t, hi)
            step = t - d1 / np.maximum(d2, 1e-300)
            new = np.where((step > lo) & (step < hi), step, (lo + hi) / 2)
            if np.abs(new - t).max() < 1e-10:
                t = new
                break
            t = new
        e = q_ * np.exp(t)[:, None]
        r = e / (1 - q_ + e)
        kk = (m * np.log1p(q_ * np.expm1(t)[:, None])).sum(1)
        var = (m * r * (1 - r)).sum(1)
        w = np.sign(t) * np.sqrt(np.maximum(2 * (t * k_ - kk), 0))
        u = -np.expm1(-t) * np.sqrt(var)
        cdf = np.array([0.5 * erfc(z / np.sqrt(2)) for z in w])
        with np.errstate(divide="ignore", invalid="ignore"):
            p = cdf + np.exp(-w * w / 2) / np.sqrt(2 * np.pi) * (1 / u - 1 / w)
        # near the mean the two terms cancel: the normal form with half a unit's correction
        near = np.abs(t) < 1e-3
        if near.any():
            sd = np.sqrt(np.maximum((m * q_ * (1 - q_)).sum(1), 1e-300))
            z = (k_ - 0.5 - mean[inner]) / sd
            p = np.where(near, [0.5 * erfc(v / np.sqrt(2)) for v in z], p)
        out[inner] = np.clip(p, 0, 1)
    return out


# -- the operator ---------------------------------------------------------------------------------------------


def pair_counts(df: DataFrame, group: str, basket: str, item: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """profiles (g, items, m), items (g, item, c), pairs (g, a, b, c12) with a < b by bytes."""
    rows = df.select(F.col(group).alias("g"), F.col(basket).alias("e"), F.col(item).alias("i")).dropna()
    sets = rows.groupBy("g", "e").agg(F.sort_array(F.collect_set("i")).alias("items"))
    profiles = checkpointed(sets.groupBy("g", "items").agg(F.count(F.lit(1)).alias("m")))
    items = profiles.select("g", "m", F.explode("items").alias("item")).groupBy("g", "item").agg(F.sum("m").alias("c"))
    small = profiles.filter(F.size("items") <= BLOCK).select("g", "m", "items", F.posexplode("items").alias("k", "a"))
    small = small.select("g", "m", "a", F.explode(F.slice("items", F.col("k") + 2, F.size("items"))).alias("b"))
    # large sets: each pair of blocks is a row of its own, wherever it lands
    blocks = profiles.filter(F.size("items") > BLOCK).withColumn("of", F.ceil(F.size("items") / BLOCK).cast("int"))
    cut = lambda k: F.slice("items", F.col(k) * BLOCK + 1, F.lit(BLOCK))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.col("of") - 1)).alias("i")).select("*", F.explode(F.sequence("i", F.col("of") - 1)).alias("j"))
    blocks = blocks.select("g", "m", cut("i").alias("left"), cut("j").alias("right")).repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    large = blocks.select("g", "m", "right", F.explode("left").alias("a")).select("g", "m", "a", F.explode(F.filter("right", lambda b: b > F.col("a"))).alias("b"))
    return profiles, items, small.unionByName(large).groupBy("g", "a", "b").agg(F.sum("m").alias("c12"))


_FITTED = pa.struct([("v", pa.int64()), ("n", pa.int64()), ("fitness", pa.float64())])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both histograms of a group with their fitnesses."""
    for batch in batches:
        out = ([], [])
        for degrees, sizes in zip(batch.column(1), batch.column(2), strict=True):
            histogram = [np.array(h.values.flatten()[0].to_numpy()) for h in (degrees, sizes)], [np.array(h.values.flatten()[1].to_numpy()) for h in (degrees, sizes)]
            order = [np.argsort(v) for v in histogram[0]]
            (d, s), (nd, ns) = ([h[o] for h, o in zip(part, order, strict=True)] for part in histogram)
            for o, v, n, f in zip(out, (d, s), (nd, ns), fit_bicm(d, nd, s, ns), strict=True):
                o.append(pa.StructArray.from_arrays([pa.array(v), pa.array(n), pa.array(f)], fields=list(_FITTED)))
        lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(x) for x in o])]).astype(np.int32)), pa.concat_arrays(o)) for o in out] if batch.num_rows else [pa.array([], pa.list_(_FITTED))] * 2
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["g", "degrees", "sizes"])


def _tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Expected count and upper tail of each triple of a chunk."""
    for batch in batches:
        for k in range(batch.num_rows):
            g, triples, degrees, sizes = (batch.column(i)[k] for i in range(4))
            c1, c2, c12, pairs = (x.to_numpy() for x in triples.values.flatten())
            v, _, fitness = (x.to_numpy() for x in degrees.values.flatten())
            _, m, y = (x.to_numpy() for x in sizes.values.flatten())
            x1, x2 = (fitness[np.searchsorted(v, c)] for c in (c1, c2))
            expected, p = np.zeros(len(c1)), np.ones(len(c1))
            rows = max(1, CELLS // len(y))
            for a in range(0, len(c1), rows):
                part = slice(a, a + rows)
                q = probability(x1[part, None], y) * probability(x2[part, None], y)
                expected[part], p[part] = (q * m).sum(1), upper_tail(c12[part], q, m)
            yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(c1), pa.string()), pa.array(c1), pa.array(c2), pa.array(c12), pa.array(pairs), pa.array(expected), pa.array(p)], names=["g", "c1", "c2", "c12", "pairs", "expected", "p_value"])


def pair_surprise(df: DataFrame, group: str, basket: str, item: str) -> DataFrame:
    """(g, a, b, c12, c1, c2, n, lift, expected, p_value, q_value) of every pair that met at least once."""
    profiles, items, pairs = pair_counts(df, group, basket, item)
    tasks = 4 * df.sparkSession.sparkContext.defaultParallelism
    degrees = items.groupBy("g", F.col("c").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    sizes = profiles.groupBy("g", F.size("items").cast("bigint").alias("v")).agg(F.sum("m").alias("n"))
    histogram = lambda h, name: h.groupBy("g").agg(F.collect_list(F.struct("v", "n")).alias(name), F.sum("n").alias(f"n_{name}"))
    both = histogram(degrees, "degrees").join(histogram(sizes, "sizes"), "g")
    totals = both.select("g", F.col("n_degrees").alias("k"), F.col("n_sizes").alias("n"))
    fitted_lists = "array<struct<v:bigint,n:bigint,fitness:double>>"
    fitted = checkpointed(mapped(both.select("g", "degrees", "sizes").repartition(tasks, "g"), _fit, f"g string, degrees {fitted_lists}, sizes {fitted_lists}"))
    side = lambda s: items.select("g", F.col("item").alias("ab"[s - 1]), F.col("c").alias(f"c{s}"))
    met = checkpointed(pairs.join(side(1), ["g", "a"]).join(side(2), ["g", "b"]).join(totals, "g").select("g", "a", "b", "c12", "c1", "c2", "n", "k"))  # read for the triples and for the result
    triples = met.groupBy("g", F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"), "c12", "k").agg(F.count(F.lit(1)).alias("pairs"))
    # a chunk of triples goes with one copy of its group's histograms
    number = F.pmod(F.xxhash64("c1", "c2", "c12"), F.ceil(F.col("k") * F.col("k") / (2 * CHUNK)))
    chunks = triples.groupBy("g", number.alias("chunk")).agg(F.collect_list(F.struct("c1", "c2", "c12", "pairs")).alias("triples"))
    schema = "g string, c1 bigint, c2 bigint, c12 bigint, pairs bigint, expected double, p_value double"
    tails = checkpointed(mapped(chunks.join(fitted, "g").select("g", "triples", "degrees", "sizes").repartition(tasks), _tails, schema))
    known = tails.join(_q_values(tails, totals, tasks), ["g", "p_value"]).drop("pairs").withColumnsRenamed({"c1": "low", "c2": "high"})
    out = met.withColumns({"low": F.least("c1", "c2"), "high": F.greatest("c1", "c2")}).join(known, ["g", "low", "high", "c12"])
    return out.select("g", "a", "b", "c12", "c1", "c2", "n", (F.col("n") * F.col("c12") / (F.col("c1") * F.col("c2"))).alias("lift"), "expected", "p_value", "q_value")


def _q_values(tails: DataFrame, totals: DataFrame, tasks: int) -> DataFrame:
    """(g, p_value, q_value) by Benjamini and Hochberg over all pairs of the items of g."""
    values = tails.groupBy("g", "p_value").agg(F.sum("pairs").alias("m")).join(totals.select("g", (F.col("k") * (F.col("k") - 1) / 2).alias("tests")), "g")
    # ranges of p-values, cut by sampling: a group of any size is spread over as many tasks as it needs
    ranged = checkpointed(values.repartitionByRange(tasks, "g", "p_value").withColumn("part", F.spark_partition_id()))
    per_part = Window.partitionBy("g").orderBy("part")
    before = ranged.groupBy("g", "part").agg(F.sum("m").alias("in_part")).select("g", "part", (F.sum("in_part").over(per_part) - F.col("in_part")).alias("before"))
    upto = Window.partitionBy("g", "part").orderBy("p_value")
    ranked = ranged.join(before, ["g", "part"]).withColumn("raw", F.least(F.lit(1.0), F.col("p_value") * F.col("tests") / (F.col("before") + F.sum("m").over(upto))))
    later = ranked.groupBy("g", "part").agg(F.min("raw").alias("low")).withColumn("later", F.min("low").over(per_part.rowsBetween(1, Window.unboundedFollowing))).drop("low")
    after = Window.partitionBy("g", "part").orderBy(F.desc("p_value"))
    return ranked.join(later, ["g", "part"]).select("g", "p_value", F.least(F.min("raw").over(after), F.coalesce("later", F.lit(1.0))).alias("q_value"))


# -- queries ----------------------------------------------------------------------------------------------------


def _baskets(spark, d: str) -> DataFrame:
    from castgraph.operators.packed import split_packed
    from castgraph.sources import table

    return split_packed(table(spark, d, "hyperedges"), "row_id", "onstage", ("play", "edge_id"), value="node")


def p4_pairs(spark, d: str) -> DataFrame:
    out = pair_surprise(_baskets(spark, d), "play", "edge_id", "node")
    return out.select(F.col("g").alias("play"), F.col("a").alias("node1"), F.col("b").alias("node2"), F.col("c12").alias("count"), "c1", "c2", "n", F.round("lift", 6).alias("lift"), F.round("expected", 6).alias("expected"), "p_value", "q_value")


def p4_found(spark, d: str) -> DataFrame:
    met = pair_surprise(_baskets(spark, d), "play", "edge_id", "node").filter((F.col("c12") >= 5) & (F.col("n") * F.col("c12") >= 2 * F.col("c1") * F.col("c2")))
    return met.select(F.col("g").alias("play"), F.col("a").alias("node1"), F.col("b").alias("node2"))


def p4_counts(spark, d: str) -> DataFrame:
    """The exact part of p4_pairs: counts and lift."""
    return p4_pairs(spark, d).select("play", "node1", "node2", "count", "c1", "c2", "n", "lift")


QUERIES = {"p4_found": p4_found, "p4_pairs": p4_pairs, "p4_counts": p4_counts}


def _sql() -> dict[str, str]:
    from castgraph.plans.problems import SQL as general

    met = f"""
WITH found AS ({general["p5_found"]}),
sets AS (SELECT DISTINCT play, edge_id, node FROM found JOIN hyperedges USING (row_id) WHERE play IS NOT NULL AND edge_id IS NOT NULL),
n AS (SELECT play, count(DISTINCT edge_id) AS n FROM sets GROUP BY play),
c AS (SELECT play, node, count(*) AS c FROM sets GROUP BY ALL),
m AS (SELECT a.play, a.node AS node1, b.node AS node2, count(*) AS c12 FROM sets a JOIN sets b ON a.play = b.play AND a.edge_id = b.edge_id AND a.node < b.node GROUP BY ALL),
met AS (SELECT m.play, node1, node2, c12, x.c AS c1, y.c AS c2, n FROM m JOIN n USING (play) JOIN c x ON x.play = m.play AND x.node = node1 JOIN c y ON y.play = m.play AND y.node = node2)"""
    return {
        "p4_found": met + " SELECT play, node1, node2 FROM met WHERE c12 >= 5 AND n * c12 >= 2 * c1 * c2",
        "p4_counts": met + " SELECT play, node1, node2, c12 AS count, c1, c2, n, round(n::DOUBLE * c12 / (c1 * c2), 6) AS lift FROM met",
    }


SQL = _sql()
