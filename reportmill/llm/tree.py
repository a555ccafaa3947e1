"""A hierarchical k-means tree over unit vectors with best-bin-first traversal, the index behind problems 4 and 5.

The tree is fitted on a bounded sample, its heaviest node split first, so leaves hold about equal shares of the data
however it clusters. A traversal keeps a priority queue of nodes per row and scores only the children of nodes it takes
from the queue. A leaf's priority is the cosine to its center; that of an inner node is the best leaf to be expected below
it, its own cosine plus what the sample rows below it gained on average, and ``spread_weight`` deviations of that. The first leaf taken is a row's home; further leaves are visited while the best
priority left in the queue is within a margin of the best leaf so far.

The margin is widened until, for a stated set of calibration queries compared with all rows, the visited leaves hold the
wanted share of the true neighbours, separately for either half of the queries. There is no bound on the visits: the
widest margin visits every leaf, which is an exact search.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm.vectors import bounded_sample, matrix, pack


@dataclass(frozen=True)
class TreeParams:
    leaf_rows: int = 1024  #: rows a leaf should hold
    max_leaves: int = 4096  #: bound of the tree, hence of its broadcast (4,096 leaves of 384 floats: 7 MB)
    branching: int = 8
    sample_rows: int = 32_768  #: bound of the rows the tree is fitted on
    queries: int = 512  #: calibration queries
    recall: float = 0.997  #: share of the calibration queries' true neighbours that must lie in visited leaves
    spread_weight: float = 2.0  #: deviations added to the mean gain; more of them score more nodes and visit fewer leaves
    block_rows: int = 4096  #: rows of a leaf that meet in one task on either side
    seed: int = 42


@dataclass(frozen=True)
class Tree:
    """Plain arrays, node 0 is the root. Broadcast as a tuple of its fields: workers need not have this package."""

    centers: np.ndarray  #: unit centers
    children: np.ndarray  #: (nodes x branching) node numbers, -1 where there is none
    bonus: np.ndarray  #: what is added to a node's cosine
    weight: np.ndarray  #: share of the sample

    @property
    def fields(self) -> tuple[np.ndarray, ...]:
        return self.centers, self.children, self.bonus, self.weight

    @property
    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.children[:, 0] < 0)


@dataclass(frozen=True)
class Index:
    tree: Tree
    margin: float
    recall: float  #: share of the calibration queries' true neighbours that lie in visited leaves
    blocks: dict[int, tuple[int, int]]  #: blocks of (home rows, visiting rows) of heavy leaves


def _kmeans(unit: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Group number of each row under spherical k-means, seeded by distance-weighted draws."""
    centers = [unit[rng.integers(len(unit))]]
    far = 1 - unit @ centers[0]
    for _ in range(1, k):
        w = np.maximum(far, 0)
        if w.sum() <= 1e-9:
            break
        centers.append(unit[rng.choice(len(unit), p=w / w.sum())])
        far = np.minimum(far, 1 - unit @ centers[-1])
    c = np.array(centers)
    for _ in range(rounds):
        group = (unit @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, group, unit)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), c)
    return (unit @ c.T).argmax(axis=1)


def fit(sample: np.ndarray, leaves: int, p: TreeParams) -> Tree:
    """A tree of about ``leaves`` leaves; the node with most sample rows is split next."""
    import heapq

    rng = np.random.default_rng(p.seed)
    centers, children, near, weight = [], [], [], []

    def add(rows: np.ndarray) -> int:
        m = sample[rows].mean(axis=0)
        m = m / max(float(np.linalg.norm(m)), 1e-9)
        centers.append(m)
        near.append((rows, sample[rows] @ m))
        weight.append(len(rows) / len(sample))
        children.append([])
        return len(centers) - 1

    everything = np.arange(len(sample))
    heap, n = [(-len(sample), add(everything), everything)], 1
    while heap and n < leaves:
        size, node, rows = heapq.heappop(heap)
        if -size < 2 * p.branching:
            break
        group = _kmeans(sample[rows], p.branching, rng)
        parts = [rows[group == g] for g in np.unique(group)]
        if len(parts) < 2:
            continue
        for part in parts:
            children[node].append(add(part))
            heapq.heappush(heap, (-len(part), children[node][-1], part))
        n += len(parts) - 1
    # the cosine of each sample row to its leaf; a row's gain below a node is that less its cosine to the node
    at_leaf = np.zeros(len(sample), np.float32)
    for v, (rows, cos) in enumerate(near):
        if not children[v]:
            at_leaf[rows] = cos
    gains = [at_leaf[rows] - cos for rows, cos in near]
    bonus = [float(g.mean() + p.spread_weight * g.std()) for g in gains]
    kids = np.full((len(centers), p.branching), -1, np.int32)
    for v, c in enumerate(children):
        kids[v, : len(c)] = c
    return Tree(np.array(centers, np.float32), kids, np.array(bonus, np.float32), np.array(weight))


def visits(tree: Tree, unit: np.ndarray, margin: float = np.inf, first: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row, leaf, gap) of every visit in best-bin-first order of each row, and how many nodes were scored in all.

    ``gap``: the least margin at which the visit is made. ``first``: only the first leaf of each row.
    All rows of a batch advance together, each by its own queue; rows that take the same node are scored in one product.
    """
    n, width = len(unit), tree.children.shape[1]
    if tree.children[0, 0] < 0:
        return np.arange(n), np.zeros(n, np.int32), np.zeros(n), 0
    queue = np.full((n, 4 * width), -np.inf, np.float32)
    node = np.zeros((n, 4 * width), np.int32)
    filled = np.zeros(n, np.int64)
    best, gap, scored = np.full(n, -np.inf), np.zeros(n), 0
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def push(rows: np.ndarray, v: int) -> int:
        nonlocal queue, node
        kids = tree.children[v][tree.children[v] >= 0]
        most = int(filled[rows].max()) + len(kids)
        if most > queue.shape[1]:
            more = max(queue.shape[1], most - queue.shape[1])
            queue = np.concatenate([queue, np.full((n, more), -np.inf, np.float32)], axis=1)
            node = np.concatenate([node, np.zeros((n, more), np.int32)], axis=1)
        at = filled[rows][:, None] + np.arange(len(kids))
        queue[rows[:, None], at] = unit[rows] @ tree.centers[kids].T + tree.bonus[kids]
        node[rows[:, None], at] = kids
        filled[rows] += len(kids)
        return len(rows) * len(kids)

    active = np.arange(n)
    if n:
        scored += push(active, 0)
    while len(active):
        seen = queue[active, : int(filled[active].max())] if len(active) < n else queue[:, : int(filled.max())]
        at = seen.argmax(axis=1)
        top = seen[np.arange(len(active)), at].astype(np.float64)
        more = top > -np.inf
        gap[active[more]] = np.maximum(gap[active[more]], best[active[more]] - top[more])
        more &= gap[active] <= margin
        active, at, top = active[more], at[more], top[more]
        taken = node[active, at]
        queue[active, at] = -np.inf
        leaf = tree.children[taken, 0] < 0
        rows = active[leaf]
        out.append((rows, taken[leaf], gap[rows].copy()))
        best[rows] = np.maximum(best[rows], top[leaf])
        inner, below = active[~leaf], taken[~leaf]
        order = np.argsort(below, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(below[order])) + 1) if len(order) else ():
            scored += push(inner[part], int(below[part[0]]))
        if first:
            active = active[~leaf]
    row, leaf, gaps = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
    order = np.argsort(row, kind="stable")
    return row[order], leaf[order], gaps[order], scored


def _true_leaves(base: DataFrame, tree: Tree, queries: np.ndarray, k: int, least: float) -> list[tuple[int, int]]:
    """(query, home leaf of a true neighbour): the k best other rows of cosine >= ``least`` of every query, by comparison with all rows."""
    shared = base.sparkSession.sparkContext.broadcast((queries, tree.fields))
    k = k + 1  # a query finds itself

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, tree = shared.value[0], Tree(*shared.value[1])
        best = np.full((len(queries), k), -2.0, np.float32)
        leaf = np.zeros((len(queries), k), np.int64)
        for b in batches:
            _, unit = matrix(b.column(0))
            if not len(unit) or unit.shape[1] != queries.shape[1]:
                continue
            sims = queries @ unit.T
            take = np.argpartition(-sims, min(k, sims.shape[1]) - 1, axis=1)[:, :k]
            new = np.take_along_axis(sims, take, axis=1)
            new = np.where(new >= least, new, -2)
            rows = np.unique(take[new > best[:, -1:]])
            home = np.zeros(len(unit), np.int64)
            if len(rows):
                home[rows] = visits(tree, unit[rows], first=True)[1]
            both, where = np.concatenate([best, new], axis=1), np.concatenate([leaf, home[take]], axis=1)
            order = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best, leaf = np.take_along_axis(both, order, axis=1), np.take_along_axis(where, order, axis=1)
        q, j = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(best[q, j].astype(np.float64)), pa.array(leaf[q, j])], ["q", "sim", "leaf"])

    w = Window.partitionBy("q").orderBy(F.desc("sim"), "leaf")
    found = base.select("vec").mapInArrow(search, "q int, sim double, leaf long").withColumn("r", F.row_number().over(w))
    return [(r.q, r.leaf) for r in found.where(F.col("r").between(2, k)).collect()]  # at most queries * k rows


def build(base: DataFrame, n: int, p: TreeParams, k: int, least: float = -2.0) -> Index | None:
    """The tree over ``n`` rows (id, vec) and the margin that finds the wanted share of the ``k`` nearest rows of cosine >= ``least``."""
    sample = bounded_sample(base, n, p.sample_rows, p.seed)
    if not len(sample):
        return None
    tree = fit(sample, max(1, min(p.max_leaves, n // p.leaf_rows)), p)
    queries = bounded_sample(base, n, p.queries, p.seed + 1)
    true = _true_leaves(base, tree, queries, k, least)
    row, leaf, gap, _ = visits(tree, queries)
    needed = dict(zip(zip(row.tolist(), leaf.tolist(), strict=True), gap.tolist(), strict=True))
    each = [(q, needed[q, v]) for q, v in true]
    margin = 0.0
    for half in (0, 1):
        gaps = np.sort([g for q, g in each if q % 2 == half])
        if len(gaps):
            margin = max(margin, float(gaps[min(len(gaps) - 1, int(np.ceil(p.recall * len(gaps))) - 1)]))
    margin += 1e-6
    recall = float(np.mean([g <= margin for _, g in each])) if each else 1.0
    # how full the leaves get, from rows of the sample: only the split into blocks rests on it
    some = sample[:: max(1, len(sample) // 4096)]
    came = np.bincount(visits(tree, some, margin)[1], minlength=len(tree.weight)) / max(len(some), 1)
    blocks = {}
    for v in tree.leaves.tolist():
        home, all_ = -(-int(tree.weight[v] * n) // p.block_rows), -(-int(max(came[v], tree.weight[v]) * n) // (2 * p.block_rows))
        if home > 1 or all_ > 1:
            blocks[v] = (max(home, 1), max(all_, 1))
    return Index(tree, margin, recall, blocks)


#: Columns of a routed row: the group it belongs to, whether it is searched there, whether it asks there, the row itself.
ROUTED = "leaf int, home_block int, ask_block int, target boolean, ask boolean, id string, vec binary"


def routed(base: DataFrame, index: Index) -> DataFrame:
    """(ROUTED): every row sent to its home leaf and the leaves it visits, as a 16-bit vector.

    A heavy leaf is split into blocks of home rows and blocks of asking rows by a hash of the id; every pair of such blocks
    is a group, so both sides of a group are bounded.
    """
    shared = base.sparkSession.sparkContext.broadcast((index.tree.fields, index.blocks, index.margin))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        tree, blocks, margin = Tree(*shared.value[0]), *shared.value[1:]
        for b in batches:
            rows, unit = matrix(b.column(1))
            if not len(unit) or unit.shape[1] != tree.centers.shape[1]:
                continue
            ids, vec = b.column(0).take(pa.array(rows)), pack(unit, 16)
            row, leaf, _, _ = visits(tree, unit, margin)
            home = np.diff(row, prepend=-1) != 0
            light = ~np.isin(leaf, np.fromiter(blocks, np.int64, len(blocks)))
            zero = np.zeros(int(light.sum()), np.int64)
            parts = [(row[light], leaf[light], zero, zero, home[light], np.ones(len(zero), bool))]
            heavy = []
            for i, v, at_home in zip(row[~light].tolist(), leaf[~light].tolist(), home[~light].tolist(), strict=True):
                homes, asks = blocks[v]
                mark = zlib.crc32(ids[i].as_py().encode())
                own, mine = mark % homes, mark // 7919 % asks
                heavy += [(i, v, h, mine, at_home and h == own, True) for h in range(homes)]
                heavy += [(i, v, own, a, True, False) for a in range(asks) if at_home and a != mine]
            if heavy:
                parts.append(tuple(np.array(x) for x in zip(*heavy, strict=True)))
            i, v, h, a, target, ask = (np.concatenate(x) for x in zip(*parts, strict=True))
            take = pa.array(i)
            yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.int32)), pa.array(h.astype(np.int32)), pa.array(a.astype(np.int32)), pa.array(target), pa.array(ask), ids.take(take), vec.take(take)], ["leaf", "home_block", "ask_block", "target", "ask", "id", "vec"])

    return base.mapInArrow(route, ROUTED)


def copies(base: DataFrame) -> DataFrame:
    """(id, rep): ids whose vector is equal to that of a smaller id; rep is the smallest. Only hashes and ids are shuffled."""
    h = base.select("id", F.xxhash64("vec").alias("h1"), F.xxhash64(F.lit(1), "vec").alias("h2"))
    shared = h.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("rep <> last").drop("last")
    return h.join(shared, ["h1", "h2"]).where("id <> rep").select("id", "rep").distinct()
