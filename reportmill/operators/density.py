"""Hierarchical density clusters of vectors: core distances, mutual reachability, condensed tree, excess of mass.

The hierarchy is fitted on at most ``fit_rows`` rows, chosen by a hash of the id (a documented bound: its spanning tree takes
quadratic work on the driver); with fewer rows it is exact. Every row then gets a label in one pass without a shuffle: that of
the nearest fitted row of a cluster, if it is as near to it as the cluster reaches, else -1.

Defined results: ids repeat once; vectors that are null, empty or zero are left out; an empty table gives no rows;
fewer rows than ``min_size`` are all noise. Labels are numbered by size in the fitted rows (ties: smaller id).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.operators import vectors


def spanning_tree(x: np.ndarray, min_samples: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ends a, ends b, weights, core distances): minimum spanning tree under mutual reachability (Euclidean), by Prim's method, a row of distances at a time."""
    n = len(x)
    square = (x * x).sum(axis=1)
    far = lambda i: np.sqrt(np.maximum(square[i] + square - 2 * (x @ x[i]), 0))
    core = np.empty(n)
    for at in range(0, n, 512):
        d = np.sqrt(np.maximum(square[at : at + 512, None] + square[None] - 2 * (x[at : at + 512] @ x.T), 0))
        core[at : at + 512] = np.partition(d, min(min_samples, n - 1), axis=1)[:, min(min_samples, n - 1)]
    best, source, done = np.full(n, np.inf), np.zeros(n, np.int64), np.zeros(n, bool)
    a, b, w, now = [], [], [], 0
    for _ in range(n - 1):
        done[now] = True
        reach = np.maximum(np.maximum(far(now), core[now]), core)
        nearer = ~done & (reach < best)
        best[nearer], source[nearer] = reach[nearer], now
        now = int(np.where(done, np.inf, best).argmin())
        a.append(source[now])
        b.append(now)
        w.append(best[now])
    return np.array(a, np.int64), np.array(b, np.int64), np.array(w), core


def condensed_labels(a: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, min_size: int) -> np.ndarray:
    """A label per row, -1 for noise: the clusters of greatest excess of mass in the condensed tree of the merges."""
    parent = np.arange(2 * n - 1)
    size = np.ones(2 * n - 1, np.int64)
    left, right, height = np.full(2 * n - 1, -1), np.full(2 * n - 1, -1), np.zeros(2 * n - 1)

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for k, e in enumerate(np.argsort(w, kind="stable")):
        x, y, new = root(a[e]), root(b[e]), n + k
        left[new], right[new], height[new], size[new] = x, y, w[e], size[x] + size[y]
        parent[x] = parent[y] = new

    def rows_of(v: int) -> list[int]:
        out, stack = [], [v]
        while stack:
            u = stack.pop()
            if u < n:
                out.append(u)
            else:
                stack += [left[u], right[u]]
        return out

    # clusters: (birth, stability, children, node); a split counts if both sides have min_size rows
    clusters: list[dict] = []

    def grow(node: int, birth: float) -> int:
        me = {"node": node, "birth": birth, "mass": 0.0, "below": []}
        clusters.append(me)
        at = len(clusters) - 1
        todo.append((at, node))
        return at

    todo: list[tuple[int, int]] = []
    if n >= min_size and n > 1:
        grow(2 * n - 2, 0.0)
    while todo:
        at, v = todo.pop()
        me = clusters[at]
        while v >= n:
            density = 1 / max(height[v], 1e-12)
            x, y = left[v], right[v]
            if size[x] >= min_size and size[y] >= min_size:
                me["mass"] += size[v] * (density - me["birth"])
                me["below"] = [grow(x, density), grow(y, density)]
                break
            for small, large in ((x, y), (y, x)):
                if size[large] >= min_size:
                    me["mass"] += size[small] * (density - me["birth"])
                    v = large
                    break
            else:
                me["mass"] += size[v] * (density - me["birth"])
                break
    chosen = [False] * len(clusters)
    total = [0.0] * len(clusters)
    for k in range(len(clusters) - 1, -1, -1):  # children come after their parents
        below = sum(total[c] for c in clusters[k]["below"])
        if k > 0 and clusters[k]["mass"] >= below:  # the root is never a cluster
            chosen[k], total[k] = True, clusters[k]["mass"]
        else:
            total[k] = below
    label = np.full(n, -1)
    stack, number = [0] if clusters else [], 0
    while stack:
        k = stack.pop()
        if chosen[k]:
            label[rows_of(clusters[k]["node"])] = number
            number += 1
        else:
            stack += clusters[k]["below"]
    return label


def fitted(x: np.ndarray, ids: list[str], min_size: int, min_samples: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, reach) per row: labels numbered by size, and how far each row's cluster reaches around it: its core distance or the longest in its cluster."""
    if len(x) < 2:
        return np.full(len(x), -1), np.zeros(len(x))
    a, b, w, core = spanning_tree(x.astype(np.float64), min_samples)
    raw = condensed_labels(a, b, w, len(x), min_size)
    found = [v for v in np.unique(raw) if v >= 0]
    found.sort(key=lambda v: (-(raw == v).sum(), min(ids[k] for k in np.flatnonzero(raw == v))))
    label, reach = np.full(len(x), -1), np.zeros(len(x))
    for number, v in enumerate(found):
        rows = raw == v
        label[rows], reach[rows] = number, core[rows].max()
    return label, reach


def clustered(embeddings: DataFrame, min_size: int = 200, min_samples: int = 10, fit_rows: int = 8192, key: str = "source_id", vector: str = "embedding") -> DataFrame:
    """(key, archetype): a label for every id with a direction."""
    rows = vectors.units(embeddings, key, vector)
    spark = embeddings.sparkSession
    picked = rows.orderBy(F.xxhash64(key), key).limit(fit_rows).toArrow()
    ids = picked.column(0).to_pylist()
    x = np.array(picked.column(1).to_pylist(), np.float64)
    total = rows.count() if len(ids) == fit_rows else len(ids)
    # of a part of the rows a cluster has fewer and its rows fewer neighbours
    share = len(ids) / max(total, 1)
    label, reach = fitted(x, ids, max(2, int(np.ceil(min_size * share))), max(1, int(np.ceil(min_samples * share))))
    shared = spark.sparkContext.broadcast((x, label, reach, dict(zip(ids, label.tolist(), strict=True))))

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, label, reach, known = shared.value
        core = np.flatnonzero(label >= 0)
        for b in batches:
            names = b.column(0).to_pylist()
            unit = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(names), -1)
            out = np.full(len(names), -1)
            if len(core) and len(names):
                cos = unit @ x[core].T
                near = cos.argmax(axis=1)
                far = np.sqrt(np.maximum(2 - 2 * cos[np.arange(len(names)), near], 0))
                out = np.where(far <= reach[core[near]], label[core[near]], -1)
            out = [known.get(k, v) for k, v in zip(names, out.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int32())], [key, "archetype"])

    return rows.mapInArrow(name, f"{key} string, archetype int")
