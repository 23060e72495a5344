"""The k most similar vectors of every vector, by a hierarchical k-means tree.

Fit.  A sample of each space's different vectors gives a tree: k-means with BRANCH children on unit vectors, split again until a node stands for
about LEAF vectors of the whole collection.  The sample grows with the collection, from SAMPLE to MOST_SAMPLE vectors, so leaves keep their size up to
about 30 million vectors a space and grow beyond.  Vectors are sampled by a threshold on the hash of their values.
Trees are broadcast; their size is bounded by the sample's.  The number of leaf visits is calibrated on the sample: visits widen from LEAST_VISITS
until RECALL of the true neighbours (by brute force over the sample, within k, at the least similarity) is reached.

Search.  Every vector descends the tree best bin first: a priority queue of nodes, best similarity to the centre on top; a
popped inner node pushes its children, a popped leaf is a visit.  The order in which the queue pops leaves is worked out for a batch of
queries from the least similarities on the leaves' ways.  A pair that either vector finds counts for both lists, which halves the visits.  Leaves are grouped into cells, neighbouring leaves of the tree;
a vector is shuffled once to its own cell as data, and once to
each further cell that holds one of its visited leaves, as a query.  A cell compares its queries with the data of the visited
leaves by matrix products, and returns the best k of each. Cells are read as a sorted stream, data first, so a task holds one cell's data and one batch of
queries, however many queries come.

Skew.  Exact copies of a vector (any number, even a third of all rows) are searched once: a class is its values,
represented by its smallest id; only its k + 1 smallest ids can ever be on a list, for equal cosines go to the smaller id.
A cell that the sample shows to be large is cut into blocks of its data by hash of the id, and its queries go to all blocks; a cell that is visited by
many queries gets several copies of its data, and each query goes to one.  So no
task grows with a hot group, and no row is dropped.

Defined results: null vectors, wrong sizes, NaN or infinite numbers and zero vectors take no part; the space is compared without
case and outer blanks; repeated deliveries count each; an empty table gives no rows; a vector alone in its space has no list.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from castgraph.functions import mapped

SPACES = {"w2v": 80, "bert": 96}
K, LEAST = 5, 0.75
SAMPLE, MOST_SAMPLE, SHARE, QUERIES_FOR_CALIBRATION = 24_000, 240_000, 25, 1_500
BRANCH, LEAF, ROUNDS = 24, 384, 8
LEAST_CELL, CELL, CELLS = 20_000, 240_000, 3  # vectors of a cell: a third of the collection within these bounds
MOST_QUERIES = 1_000_000  # of a cell, beyond which it gets a further copy of its data
RECALL = 0.98
LEAST_VISITS = 4
DENSE, UPPER, ROWS = 1024, 100, 512  # nodes of a tree whose similarities are all worked out, of the upper part of a larger one, and rows at a time
TIE = 1e-6  # weight of the next similarity, which decides between leaves with the same least one on their way
SLACK = 1e-4  # float32 products are taken a little below the least similarity, then done again in float64
BATCH = 2048
HELD = 1 << 21  # pairs kept before all but the best of each are dropped
MEMBERS = 20_000  # copies of a vector whose lists one task writes


# -- the tree ----------------------------------------------------------------------------------------------------


def _kmeans(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Spherical k-means: the cluster number of each row."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), k, replace=False)]
    label = np.zeros(len(x), np.int64)
    for _ in range(ROUNDS):
        label = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        empty = np.bincount(label, minlength=k) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return label


@dataclass
class _Part:
    """A node and what follows it: centres without its own; by level, places and those of their parents; places and numbers of the leaves."""

    centres: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray]]
    leaves: np.ndarray
    names: np.ndarray

    def least(self, x: np.ndarray, top: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """nodes x rows: the least similarity on the way to a node, and the least on the way after that one (2 if none); top and after are the first node's.
        rows x leaves: keys that fall in the order in which leaves are popped; where both are equal, by the leaf's own similarity."""
        near = self.centres @ x.T
        low, then = (np.empty((len(near) + 1, len(x)), np.float32) for _ in range(2))
        low[0], then[0] = top, after
        for at, parents in self.levels:
            s, over = near[at - 1], low[parents]
            low[at] = np.minimum(over, s)
            then[at] = np.where(s < over, np.float32(2), np.minimum(then[parents], s))
        return low, then, (low[self.leaves] + TIE * (then[self.leaves] + TIE * near[self.leaves - 1].astype(np.float64))).T


def _first(keys: np.ndarray, names: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Fills out with each row's names by falling keys; the last key taken."""
    n = min(out.shape[1], keys.shape[1])
    best = np.argpartition(-keys, n - 1, axis=1)[:, :n]
    k = np.take_along_axis(keys, best, 1)
    order = np.argsort(-k, axis=1, kind="stable")
    out[:, :n] = np.take_along_axis(names, np.take_along_axis(best, order, 1), 1)
    return k.min(1)


@dataclass
class Tree:
    """children: rows of node numbers, -1 beyond the last; leaf: a node's leaf number or -1; cell: of each leaf; blocks and salts: of each cell."""

    centres: np.ndarray
    children: np.ndarray
    leaf: np.ndarray
    cell: np.ndarray
    blocks: np.ndarray
    salts: np.ndarray
    visits: int

    @staticmethod
    def fit(x: np.ndarray, total: int) -> Tree:
        """x: the sample's unit vectors; total: size of the collection."""
        centres, children, leaf, sizes = [x.mean(0)], [[]], [-1], []
        scale = total / max(1, len(x))
        most = min(CELL, max(LEAST_CELL, total / CELLS))

        def grow(node: int, rows: np.ndarray) -> None:
            expected = len(rows) * scale
            if expected > LEAF and len(rows) >= 4:
                k = int(min(BRANCH, max(2, np.ceil(expected / LEAF)), len(rows) // 2))
                label = _kmeans(x[rows], k, node)
                if len(np.unique(label)) > 1:
                    for c in np.unique(label):
                        mine = rows[label == c]
                        centre = x[mine].sum(0)
                        centres.append(centre / max(np.linalg.norm(centre), 1e-12))
                        children.append([])
                        leaf.append(-1)
                        children[node].append(len(centres) - 1)
                        grow(len(centres) - 1, mine)
                    return
            leaf[node] = len(sizes)
            sizes.append(expected)

        grow(0, np.arange(len(x)))
        width = max(1, max(map(len, children)))
        table = np.full((len(children), width), -1, np.int64)
        for i, c in enumerate(children):
            table[i, : len(c)] = c
        # leaves are numbered along the tree, so a run of numbers is a neighbourhood
        cell, held, number = [], 0.0, 0
        for s in sizes:
            if held and held + s > most:
                number, held = number + 1, 0.0
            cell.append(number)
            held += s
        blocks = np.maximum(1, np.ceil(np.bincount(cell, sizes) / (2 * CELL))).astype(np.int64)
        return Tree(np.array(centres, np.float32), table, np.array(leaf), np.array(cell), blocks, np.ones_like(blocks), len(sizes))

    @cached_property
    def parts(self) -> tuple[_Part, np.ndarray, list[_Part]]:
        """The upper part of the tree, the places in it of the inner nodes at its lower edge, and the part below each of these; a small tree is all upper part."""
        n = len(self.children)
        row, column = np.nonzero(self.children >= 0)
        parent, depth = np.full(n, -1), np.zeros(n, np.int64)
        parent[self.children[row, column]] = row
        for v in range(1, n):  # a node's subtree is the run of numbers that follows it
            depth[v] = depth[parent[v]] + 1
        nodes = np.cumsum(np.bincount(depth))
        cut = len(nodes) - 1 if n <= DENSE else max(1, int(np.searchsorted(nodes, UPPER, "right")) - 1)

        def part(nodes: np.ndarray) -> _Part:
            levels = [np.flatnonzero(depth[nodes] == d) for d in range(depth[nodes[0]] + 1, depth[nodes].max() + 1)]
            leaves = np.flatnonzero(self.leaf[nodes] >= 0)
            return _Part(self.centres[nodes[1:]], [(at, np.searchsorted(nodes, parent[nodes[at]])) for at in levels], leaves, self.leaf[nodes[leaves]])

        upper = np.flatnonzero(depth <= cut)
        edge = np.flatnonzero((depth == cut) & (self.leaf < 0))
        ends = [next((w for w in range(v + 1, n) if depth[w] <= cut), n) for v in edge]
        return part(upper), np.searchsorted(upper, edge), [part(np.arange(v, w)) for v, w in zip(edge, ends, strict=True)]

    def visit(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The leaves each row visits, best bin first; -1 where there are no more.

        A queue pops a leaf when everything above the least similarity on its path has been popped, so the leaves come by that similarity, those of equal ones by the least
        below it. Both are worked out for all rows and nodes of the upper part at once, and then below the best edges only, as many as could hold a visited leaf.
        """
        out = np.full((len(x), visits), -1, np.int64)
        if self.leaf[0] >= 0:
            out[:, 0] = self.leaf[0]
            return out
        for k in range(0, len(x), ROWS):
            self._visit(x[k : k + ROWS], out[k : k + ROWS])
        return out

    def _visit(self, x: np.ndarray, out: np.ndarray) -> None:
        upper, edge, below = self.parts
        start = np.full((2, len(x)), 2.0, np.float32)
        least, after, flat = upper.least(x, *start)
        if not len(edge):
            _first(flat, np.broadcast_to(upper.names, flat.shape), out)
            return
        bound, visits, todo = least[edge].T, out.shape[1], np.arange(len(x))
        most = max(len(b.names) for b in below)
        tried = int(max(8, -(-2 * visits * len(below) // sum(len(b.names) for b in below))))
        while len(todo):
            tried = min(tried, len(edge))
            best = np.argpartition(-bound[todo], tried - 1, axis=1)[:, :tried]
            chosen = np.zeros((len(todo), len(edge)), bool)
            chosen[np.arange(len(todo))[:, None], best] = True
            width = flat.shape[1]
            keys, names = np.full((len(todo), width + tried * most), -np.inf), np.full((len(todo), width + tried * most), -1)
            keys[:, :width], names[:, :width] = flat[todo], upper.names
            used = np.full(len(todo), width)
            for e in np.flatnonzero(chosen.any(0)):  # one product for all rows at the same edge
                rows, part = np.flatnonzero(chosen[:, e]), below[e]
                mine = todo[rows]
                at = used[rows][:, None] + np.arange(len(part.names))
                keys[rows[:, None], at] = part.least(x[mine], least[edge[e], mine], after[edge[e], mine])[2]
                names[rows[:, None], at] = part.names
                used[rows] += len(part.names)
            found = np.full((len(todo), visits), -1, np.int64)
            last = _first(keys, names, found)
            rest = np.where(chosen, -np.inf, bound[todo]).max(1)
            whole = (last > rest + 3 * TIE) | (tried == len(edge))
            out[todo[whole]] = found[whole]
            todo, tried = todo[~whole], 2 * tried

    def calibrate(self, x: np.ndarray, k: int, least: float, total: int | None = None, both: bool = False) -> None:
        """Sets visits to the fewest that reach RECALL of the sample's neighbours, and salts by the visits of each cell; both: a pair found by either of its vectors is found."""
        at = np.linspace(0, len(x) - 1, min(len(x), QUERIES_FOR_CALIBRATION)).astype(np.int64)
        left, right = [], []
        for part in np.array_split(at, max(1, len(at) // 64)):
            s = x[part] @ x.T
            s[np.arange(len(part)), part] = -2
            best = np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, :k]
            q, j = np.nonzero(np.take_along_axis(s, best, 1) >= least)
            left.append(part[q]), right.append(best[q, j])
        left, right = np.concatenate(left), np.concatenate(right)
        mine, place = np.unique(np.concatenate([left, right]), return_inverse=True)
        home = self.visit(x[mine], 1)[:, 0]
        a, b = place[: len(left)], place[len(left) :]
        leaves, tried = len(self.cell), 32
        while True:
            seen = self.visit(x[mine], min(leaves, tried))
            reached = []  # the visit at which a pair is found, from either side
            for k in range(0, len(left), 4096):
                i, j = a[k : k + 4096], b[k : k + 4096]
                hits = (seen[i] == home[j][:, None]) | (both & (seen[j] == home[i][:, None]))
                reached.append(np.where(hits.any(1), hits.argmax(1), leaves))
            reached = np.concatenate([np.zeros(0, np.int64), *reached])
            enough = np.flatnonzero(np.cumsum(np.bincount(reached, minlength=leaves + 1))[:leaves] >= RECALL * len(left))
            if len(enough) or tried >= leaves:
                break
            tried *= 2
        visits = int(enough[0]) + 1 if len(enough) else leaves
        self.visits = min(leaves, max(LEAST_VISITS, visits))
        some = x[np.linspace(0, len(x) - 1, min(len(x), 2 * QUERIES_FOR_CALIBRATION)).astype(np.int64)]
        cells = self.cells(self.visit(some, self.visits))
        queries = np.bincount(cells[cells >= 0], minlength=len(self.blocks)) * ((total or len(x)) / len(some))
        self.salts = np.maximum(1, np.ceil(queries / MOST_QUERIES)).astype(np.int64)

    def cells(self, leaves: np.ndarray) -> np.ndarray:
        """The different cells of each row's leaves; -1 elsewhere."""
        cells = np.sort(np.where(leaves >= 0, self.cell[leaves], -1), axis=1)
        cells[:, 1:][cells[:, 1:] == cells[:, :-1]] = -1
        return cells


# -- stages ------------------------------------------------------------------------------------------------------


def _matrix(column: pa.ListArray, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.ListArray:
    n, dim = x.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * dim + 1, dim, dtype=np.int32)), pa.array(np.ascontiguousarray(x, np.float32).ravel()))


def valid_vectors(df: DataFrame, id_col: str, space_col: str, vec_col: str, spaces: dict[str, int]) -> DataFrame:
    """(id, space, vec) of the vectors that take part."""
    named = df.select(F.col(id_col).alias("id"), F.lower(F.trim(F.col(space_col))).alias("space"), F.col(vec_col).cast("array<float>").alias("vec"))
    right = F.lit(False)
    for name, dim in spaces.items():
        right = right | ((F.col("space") == name) & (F.size("vec") == dim))
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return named.filter(F.col("id").isNotNull() & right & finite & F.exists("vec", lambda v: v != 0))


def _repeated(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's index n times, and 0 to n - 1 beside it."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _route(trees) -> callable:
    """Rows for the cells: a vector as data of its own cell, and as a query of every cell with a visited leaf."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(1).to_pandas().to_numpy()
            for space, tree in trees.value.items():
                mine = np.flatnonzero(names == space)
                for part in np.array_split(mine, max(1, -(-len(mine) // BATCH))) if len(mine) else ():
                    ids = batch.column(0).to_numpy(zero_copy_only=False)[part]
                    column = batch.column(2).take(pa.array(part))
                    x = _unit(_matrix(column, tree.centres.shape[1]))
                    leaves = tree.visit(x, tree.visits)
                    home = tree.cell[leaves[:, 0]]
                    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    block = (mixed >> np.uint64(40)).astype(np.int64) % tree.blocks[home]
                    pick = (mixed >> np.uint64(20)).astype(np.int64) & 0xFFFFF
                    # data: to its block in every copy of its cell
                    d_row, d_salt = _repeated(tree.salts[home])
                    # queries: to every block of one copy of each visited cell
                    visited_cells = tree.cells(leaves)
                    q_row, at = np.nonzero(visited_cells >= 0)
                    q_cell = visited_cells[q_row, at]
                    again, q_block = _repeated(tree.blocks[q_cell])
                    q_row, q_cell = q_row[again], q_cell[again]
                    q_salt = pick[q_row] % tree.salts[q_cell]
                    other = ~((q_cell == home[q_row]) & (q_block == block[q_row]))  # there the data row is the query too
                    row = np.concatenate([d_row, q_row[other]])
                    goal = np.concatenate([home[d_row], q_cell[other]])
                    piece = np.concatenate([block[d_row] * tree.salts[home[d_row]] + d_salt, (q_block * tree.salts[q_cell] + q_salt)[other]])
                    asks = np.concatenate([d_salt == (pick % tree.salts[home])[d_row], np.ones(int(other.sum()), bool)])
                    is_data = np.arange(len(row)) < len(d_row)
                    seen = leaves[row]
                    seen = np.where((seen >= 0) & (tree.cell[seen] == goal[:, None]) & asks[:, None], seen, -1)
                    visited = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum((seen >= 0).sum(1))]).astype(np.int32)), pa.array(seen[seen >= 0].astype(np.int32)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([space] * len(row)), pa.array(goal.astype(np.int32)), pa.array(piece.astype(np.int32)), pa.array(ids[row]), pa.array(np.where(is_data, leaves[row, 0], -1).astype(np.int32)), visited, column.take(pa.array(row))],
                        names=["space", "cell", "block", "id", "leaf", "visits", "vec"],
                    )

    return run



def best_of(left: np.ndarray, right_id: np.ndarray, cosine: np.ndarray, keep: int) -> np.ndarray:
    """Indices of each left's first ``keep`` entries by falling cosine, then by id."""
    order = np.lexsort((right_id, -cosine, left))
    left = left[order]
    first = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(left)))
    rank = np.arange(len(left)) - np.repeat(first, n)
    return order[rank < keep]


class _Cell:
    """One cell's data, gathered from the stream, and the search of its queries."""

    def __init__(self, keep: int, least: float):
        self.keep, self.least = keep, least
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, pa.ListArray]] = []
        self.built = False

    def add(self, ids: np.ndarray, leaf: np.ndarray, raw: np.ndarray, visits: pa.ListArray) -> None:
        self.parts.append((ids, leaf, raw, visits))

    def build(self) -> Iterator[pa.RecordBatch]:
        """Sorts the data by leaf, and answers the data's own queries."""
        if self.built or not self.parts:
            self.built = True
            return
        self.built = True
        self.ids = np.concatenate([p[0] for p in self.parts])
        leaf = np.concatenate([p[1] for p in self.parts])
        self.raw = np.concatenate([p[2] for p in self.parts])
        order = np.argsort(leaf, kind="stable")
        self.ids, self.raw, self.leaf = self.ids[order], self.raw[order], leaf[order]
        self.norm = np.sqrt(np.einsum("ij,ij->i", self.raw, self.raw, dtype=np.float64))
        own, self.parts = self.parts, []
        for ids, _, raw, visits in own:
            yield from self.search(ids, raw, visits)

    def search(self, ids: np.ndarray, raw: np.ndarray, visits: pa.ListArray) -> Iterator[pa.RecordBatch]:
        if not hasattr(self, "leaf"):
            return
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw, dtype=np.float64))
        small = raw / norm.astype(np.float32)[:, None]
        at_leaf = visits.flatten().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(ids)), visits.value_lengths().to_numpy(zero_copy_only=False))
        order = np.argsort(at_leaf, kind="stable")
        at_leaf, row = at_leaf[order], row[order]
        first = np.flatnonzero(np.diff(at_leaf, prepend=-1))
        found, held = [], 0
        for a, b in zip(first, np.append(first[1:], len(at_leaf)), strict=True):
            lo, hi = np.searchsorted(self.leaf, [at_leaf[a], at_leaf[a] + 1])
            if lo == hi:
                continue
            against = (self.raw[lo:hi] / self.norm[lo:hi].astype(np.float32)[:, None]).T
            step = max(1, (1 << 20) // (hi - lo))
            for c in range(a, b, step):
                rows = row[c : min(b, c + step)]
                hits = np.flatnonzero(small[rows] @ against >= self.least - SLACK)
                q, k = np.divmod(hits, hi - lo)
                left, right = rows[q], lo + k
                other = ids[left] != self.ids[right]
                left, right = left[other], right[other]
                cosine = np.empty(len(left))
                for e in range(0, len(left), 1 << 14):  # exact, a slice at a time
                    i, j = left[e : e + (1 << 14)], right[e : e + (1 << 14)]
                    cosine[e : e + (1 << 14)] = np.einsum("ij,ij->i", raw[i], self.raw[j], dtype=np.float64)
                cosine = np.round(cosine / (norm[left] * self.norm[right]), 6)
                good = cosine >= self.least
                left, right, cosine = ids[left[good]], self.ids[right[good]], cosine[good]
                found.append((np.concatenate([left, right]), np.concatenate([right, left]), np.concatenate([cosine, cosine])))  # a pair counts for both
                held += 2 * len(left)
                if held > HELD:
                    found = [self._best(found)]
                    held = len(found[0][0])
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in self._best(found)], names=["rep", "other", "cosine"])

    def _best(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        left, right, cosine = (np.concatenate(f) for f in zip(*found, strict=True))
        order = np.lexsort((right, left))
        left, right, cosine = left[order], right[order], cosine[order]
        new = np.ones(len(left), bool)
        new[1:] = (left[1:] != left[:-1]) | (right[1:] != right[:-1])
        left, right, cosine = left[new], right[new], cosine[new]
        best = best_of(left, right, cosine, self.keep)
        return left[best], right[best], cosine[best]


def _compare(keep: int, least: float) -> callable:
    """A sorted stream of cells, each cell's data before its queries: only one cell's data is held, and a batch of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key = _Cell(keep, least), None
        for batch in batches:
            if not batch.num_rows:
                continue
            names, numbers = batch.column(0).to_pandas().to_numpy(), [batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3, 4)]
            new = np.ones(batch.num_rows, bool)
            is_data = numbers[3] >= 0
            new[1:] = (names[1:] != names[:-1]) | (numbers[0][1:] != numbers[0][:-1]) | (numbers[1][1:] != numbers[1][:-1]) | (is_data[1:] != is_data[:-1])
            edges = np.append(np.flatnonzero(new), batch.num_rows)
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                here = (names[a], numbers[0][a], numbers[1][a])
                if here != key:
                    yield from cell.build()
                    cell, key = _Cell(keep, least), here
                vec = batch.column(6).slice(a, b - a)
                raw = vec.flatten().to_numpy(zero_copy_only=False).reshape(b - a, -1)
                visits = batch.column(5).slice(a, b - a)
                if is_data[a]:
                    cell.add(numbers[2][a:b], numbers[3][a:b], raw, visits)
                else:
                    yield from cell.build()
                    yield from cell.search(numbers[2][a:b], raw, visits)
        yield from cell.build()

    return run


def fit_trees(keyed: DataFrame, spaces: dict[str, int], k: int, least: float) -> dict[str, Tree]:
    """keyed: vectors with the hashes of their values (h1, h2). Equal vectors are sampled together, and count as one."""
    totals = {r["space"]: r["n"] for r in keyed.groupBy("space").agg(F.approx_count_distinct("h1", 0.02).alias("n")).collect()}  # a row per space
    trees = {}
    for space in spaces:
        if total := totals.get(space):
            share = min(MOST_SAMPLE, max(SAMPLE, total // SHARE)) / total
            rows = keyed.filter(F.col("space") == space)
            if share < 1:
                rows = rows.filter(F.xxhash64("h1", "h2") < int((2 * share - 1) * 2**63))
            rows = rows.groupBy("h1", "h2").agg(F.first("vec").alias("vec")).orderBy("h1", "h2").select("vec").toArrow()  # about ``share`` of the different vectors
            x = _unit(_matrix(rows.column("vec").combine_chunks(), spaces[space]))
            total = max(total, len(x))
            trees[space] = Tree.fit(x, total)
            trees[space].calibrate(x, k, least, total, both=True)
    return trees


def neighbours(df: DataFrame, spark: SparkSession, id_col: str = "vec_id", space_col: str = "space", vec_col: str = "vec", spaces: dict[str, int] = SPACES, k: int = K, least: float = LEAST) -> DataFrame:
    """(id, other, cosine): the list of every vector."""
    rows = valid_vectors(df, id_col, space_col, vec_col, spaces)
    keyed = rows.withColumn("h1", F.xxhash64("space", "vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec", "space"))
    classes = keyed.groupBy("space", "h1", "h2").agg(F.min("id").alias("id"), F.first("vec").alias("vec")).select("space", "id", "vec")
    trees = fit_trees(keyed, spaces, k, least)
    if not trees:
        return spark.createDataFrame([], "id bigint, other bigint, cosine double")
    shared = spark.sparkContext.broadcast(trees)
    routed = mapped(classes.select("id", "space", "vec"), _route(shared), "space string, cell int, block int, id bigint, leaf int, visits array<int>, vec array<float>")
    groups = sum(int((t.blocks * t.salts).sum()) for t in trees.values())
    cells = routed.repartition(4 * groups, "space", "cell", "block").sortWithinPartitions("space", "cell", "block", F.desc("leaf"))
    between = mapped(cells, _compare(k + 1, least), "rep bigint, other bigint, cosine double")
    # members of the classes: all ids with their class, and the few ids of each class that can be on a list
    ids = keyed.select("h1", "h2", "id")
    copies = ids.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / MEMBERS).cast("int"))
    member = ids.join(copies, ["h1", "h2"]).select("rep", "id", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part"))
    # (a class's smallest ids: first of each part, so no class is sorted whole)
    few = member.withColumn("r", F.row_number().over(Window.partitionBy("rep", "part").orderBy("id"))).filter(F.col("r") <= k + 1)
    listed = few.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).filter(F.col("r") <= k + 1).select("rep", "id")
    more = between.join(listed.select(F.col("rep").alias("other"), F.col("id").alias("copy")), "other", "left")
    entries = more.select("rep", F.coalesce("copy", "other").alias("other"), "cosine").unionByName(listed.select("rep", F.col("id").alias("other"), F.lit(1.0).alias("cosine")))
    # a pair may come from both of its vectors; equal entries are neighbours in the order
    best = Window.partitionBy("rep").orderBy(F.desc("cosine"), "other")
    ranked = entries.withColumn("r", F.dense_rank().over(best)).filter(F.col("r") <= k + 1).withColumn("again", F.lag("other").over(best).eqNullSafe(F.col("other")))
    of_class = ranked.filter(~F.col("again")).select("rep", "other", "cosine").join(copies.select("rep", "parts"), "rep", "left")
    spread = of_class.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("parts"), F.lit(1)) - 1))).drop("parts")
    own = spread.join(member.withColumnRenamed("id", "m"), ["rep", "part"], "left")
    lists = own.select(F.coalesce("m", "rep").alias("id"), "other", "cosine").filter(F.col("id") != F.col("other"))
    last = Window.partitionBy("id").orderBy(F.desc("cosine"), "other")
    return lists.withColumn("r", F.row_number().over(last)).filter(F.col("r") <= k).drop("r")


def p1_lists(spark, d: str) -> DataFrame:
    from castgraph.sources import table

    out = neighbours(table(spark, d, "vectors"), spark)
    return out.select(F.col("id").alias("vec_id"), F.col("other").alias("other_id"), "cosine")


def p1_found(spark, d: str) -> DataFrame:
    lists = p1_lists(spark, d)
    return lists.select(F.least("vec_id", "other_id").alias("vec_a"), F.greatest("vec_id", "other_id").alias("vec_b")).distinct()


QUERIES = {"p1_found": p1_found, "p1_lists": p1_lists}
_SIMILAR = """
WITH v AS (
  SELECT vec_id, lower(trim(space)) AS space, list_transform(vec, lambda x: x::DOUBLE) AS vec FROM vectors
  WHERE vec IS NOT NULL AND len(vec) = CASE lower(trim(space)) WHEN 'w2v' THEN 80 WHEN 'bert' THEN 96 END
), ok AS (
  SELECT * FROM v WHERE len(list_filter(vec, lambda x: x IS NULL OR isnan(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
), s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.vec, b.vec), 6) AS c FROM ok a JOIN ok b ON a.space = b.space AND a.vec_id <> b.vec_id
), r AS (SELECT a, b, c, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)"""
SQL = {
    "p1_found": _SIMILAR + " SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM r WHERE k <= 5 AND c >= 0.75",
    "p1_lists": _SIMILAR + " SELECT a AS vec_id, b AS other_id, c AS cosine FROM r WHERE k <= 5 AND c >= 0.75",
}
