"""Neighbours and clusters against brute force."""

import numpy as np
import pytest

from reportmill.llm import clusters, neighbors, tree
from reportmill.llm.clusters import ClusterParams
from reportmill.operators.components import components
from reportmill.llm.neighbors import NeighborParams
from reportmill.llm.tree import TreeParams

SCHEMA = "source_id string, embedding array<float>, id string, vec int"


def frame(spark, x, extra=()):
    rows = [(f"s{k:05d}", v.tolist(), "clash", 1) for k, v in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, SCHEMA).repartition(4)


def families(rng, n_clusters, per_cluster, dim=48):
    out = []
    for _ in range(n_clusters):
        c = rng.standard_normal(dim)
        c /= np.linalg.norm(c)
        for _ in range(per_cluster):
            f = 0.75 * c + 0.66 * (g := rng.standard_normal(dim)) / np.linalg.norm(g)
            out += [f + 0.3 * (h := rng.standard_normal(dim)) / np.linalg.norm(h) for _ in range(rng.integers(6, 9))]
    return np.array(out)


def brute(x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return u, s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_with_many_leaves(spark):
    x = families(np.random.default_rng(1), 25, 8)
    bad = [("s00000", x[0].tolist(), None, None), ("n1", None, None, None), ("n2", [], None, None), ("n3", [0.0] * 48, None, None), ("n4", [float("nan")] * 48, None, None), ("n5", [1.0, 2.0], None, None), (None, x[1].tolist(), None, None)]
    got = neighbors.neighbors(frame(spark, x, bad), NeighborParams(tree=TreeParams(leaf_rows=64))).toPandas()
    _, _, top = brute(x, 5)
    near = got.groupby("id").neighbor.agg(set)
    recall = np.mean([len(near[f"s{i:05d}"] & {f"s{j:05d}" for j in top[i]}) / 5 for i in range(len(x))])
    assert recall >= 0.95 and (got.groupby("id").size() == 5).all() and len(near) == len(x) and (got.id != got.neighbor).all()


def test_blocks_change_nothing(spark):
    x = families(np.random.default_rng(2), 4, 8)
    a = neighbors.neighbors(frame(spark, x), NeighborParams(tree=TreeParams(leaf_rows=10_000))).toPandas()
    b = neighbors.neighbors(frame(spark, x), NeighborParams(tree=TreeParams(leaf_rows=10_000, block_rows=50))).toPandas()
    assert set(zip(a.id, a.neighbor)) == set(zip(b.id, b.neighbor))


def test_copies_of_a_third_of_all_rows(spark):
    x = families(np.random.default_rng(3), 6, 8)
    x[: len(x) // 3] = x[0]
    got = neighbors.neighbors(frame(spark, x), NeighborParams(tree=TreeParams(leaf_rows=64))).toPandas()
    near = got.groupby("id").neighbor.agg(set)
    assert near["s00000"] == {f"s{k:05d}" for k in range(1, 6)} and near["s00040"] == {f"s{k:05d}" for k in range(5)}
    assert (got.groupby("id").size() == 5).all() and len(near) == len(x)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    got = neighbors.neighbors(frame(spark, np.eye(8)[:n])).toPandas()
    assert len(got) == n * (n - 1)


def brute_clusters(x, threshold, least):
    _, s, _ = brute(x, 1)
    left, out = set(range(len(x))), set()
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            seen.add(i)
            new = {j for j in left if s[i, j] >= threshold}
            left -= new
            todo += new
        if len(seen) >= least:
            out.add(tuple(sorted(f"s{i:05d}" for i in seen)))
    return out


def test_clusters_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([families(rng, 5, 6, 96), families(rng, 20, 1, 96)])
    bad = [("s00001", x[1].tolist(), None, None), ("n1", None, None, None), (None, x[1].tolist(), None, None), ("n3", [0.0] * 96, None, None)]
    for p in (ClusterParams(tree=TreeParams(leaf_rows=40)), ClusterParams(tree=TreeParams(leaf_rows=300, block_rows=16))):
        got = clusters.clusters(frame(spark, x, bad), p).toPandas()
        assert {tuple(sorted(g)) for _, g in got.groupby("cluster_key").source_id} == brute_clusters(x, 0.42, 10)
        assert (got.groupby("cluster_key").source_id.min() == got.groupby("cluster_key").cluster_key.first()).all()
    top = clusters.describe(clusters.clusters(frame(spark, x))).collect()
    assert all(len(r.typical) == 3 and r["size"] >= 10 for r in top)
    named = clusters.relabelled(frame(spark, x)).toPandas()
    assert len(named) == len(x) and set(named.archetype) == {-1, *range(5)}


def test_clusters_of_nothing(spark):
    assert clusters.clusters(frame(spark, np.zeros((0, 4)))).count() == 0


def test_cell_links_join_what_brute_force_joins():
    # two tight families at 0 and 180 degrees, joined over rows at 60 and 120 only
    deg = np.radians([0] * 32 + [180] * 32 + [60, 120])
    x = np.stack([np.cos(deg), np.sin(deg)], 1).astype(np.float32)
    a, b, sure, near = clusters.cell_links(x, x, 0.42, np.arange(len(x)))
    label = np.arange(len(x))
    for _ in range(10):
        for i, j in zip(a[sure], b[sure], strict=True):
            label[label == label[j]] = label[i]
        sets = clusters.joined_sets(x, 0.42)
        for s in np.unique(sets):
            label[np.isin(label, label[sets == s])] = label[sets == s][0]
    assert len(set(label.tolist())) == 1 and near[0] == 32 and near[64] == 33


def test_border_links_are_decided_on_full_vectors(spark):
    at = lambda c: np.array([c, np.sqrt(1 - c * c)] + [0.0] * 6)
    base = np.array([1.0] + [0.0] * 7)
    for c, joined in ((0.4200004, True), (0.4199996, False), (0.421, True)):
        x = np.stack([base + 1e-4 * k * np.eye(8)[3] for k in range(5)] + [at(c) + 1e-9 * k * np.eye(8)[4] for k in range(5)])
        got = clusters.clusters(frame(spark, x), ClusterParams(min_size=10)).count()
        assert (got == 10) == (len(max(brute_clusters(x.astype(np.float32).astype(float), 0.42, 1), key=len)) == 10), c


def test_cells_above_the_block_size_lose_no_link(spark):
    deg = np.radians(np.concatenate([np.linspace(0, 5, 60), [65, 66], np.linspace(125, 130, 60)]))
    x = np.stack([np.cos(deg), np.sin(deg)] + [np.zeros(len(deg))] * 6, 1)
    got = clusters.clusters(frame(spark, x), ClusterParams(tree=TreeParams(leaf_rows=10_000, block_rows=8))).toPandas()
    assert len(got) == len(x) and got.cluster_key.nunique() == 1


def test_traversal_is_best_bin_first():
    rng = np.random.default_rng(8)
    x = families(rng, 30, 8, 32)
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    t = tree.fit(x, 60, TreeParams())
    row, leaf, gap, scored = tree.visits(t, x)
    assert len(row) == len(x) * len(t.leaves) and len(set(zip(row.tolist(), leaf.tolist(), strict=True))) == len(row)  # without a margin every leaf is visited once
    flat = np.array([t.leaves[np.argsort(-(u @ t.centers[t.leaves].T))] for u in x[:100]])
    assert (leaf.reshape(len(x), -1)[:100] != flat).any()  # a descent, not a sort of all leaves
    near = tree.visits(t, x, 0.05)
    keep = gap <= 0.05
    assert (near[0] == row[keep]).all() and (near[1] == leaf[keep]).all() and near[3] < scored  # fewer nodes are scored within a margin
    first = tree.visits(t, x, first=True)
    assert (first[0] == np.arange(len(x))).all() and (first[1] == leaf.reshape(len(x), -1)[:, 0]).all()


def test_calibrated_recall_is_reported(spark):
    x = families(np.random.default_rng(5), 25, 8)
    got = neighbors.quality(frame(spark, x), NeighborParams(tree=TreeParams(leaf_rows=64))).first()
    assert got.recall >= 0.997 and got.n_leaves > 4
    # vectors without any families: the margin widens as far as it must
    y = np.random.default_rng(6).standard_normal((600, 24))
    p = NeighborParams(tree=TreeParams(leaf_rows=32))
    near = neighbors.neighbors(frame(spark, y), p).toPandas().groupby("id").neighbor.agg(set)
    top = brute(y, 5)[2]
    assert np.mean([len(near[f"s{i:05d}"] & {f"s{j:05d}" for j in top[i]}) / 5 for i in range(len(y))]) >= 0.99


def test_components(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = components(spark.createDataFrame(edges, "a int, b int")).toPandas()
    assert got.node.is_unique and {k: set(g) for k, g in got.groupby("label").node} == {0: set(range(61)), 100: set(range(100, 140)), 200: {200, 201}}
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_small_clusters_among_noise(spark):
    rng = np.random.default_rng(6)
    unit = lambda n: (g := rng.standard_normal((n, 384))) / np.linalg.norm(g, axis=1, keepdims=True)
    x = np.concatenate([0.74 * unit(1) + 0.67 * unit(n) for n in (10, 10, 12, 15, 20, 30)] + [unit(1100)])
    got = clusters.clusters(frame(spark, x), ClusterParams(tree=TreeParams(leaf_rows=32))).toPandas()
    assert {tuple(sorted(g)) for _, g in got.groupby("cluster_key").source_id} == brute_clusters(x, 0.42, 10)
    assert len(set(got.cluster_key)) == 6 and (got.density >= 1).all()


def test_repeated_rows_do_not_add_to_density(spark):
    x = families(np.random.default_rng(9), 1, 6, 96)
    once = clusters.clusters(frame(spark, x)).toPandas().set_index("source_id").density
    again = clusters.clusters(frame(spark, x, [("s00000", x[0].tolist(), "c", 1)] * 5)).toPandas().set_index("source_id").density
    assert (once.sort_index() == again.sort_index()).all()
