"""The k most similar vectors of every vector, through a hierarchical k-means tree.

Every row is indexed in the leaf that a best-bin-first descent takes first (``tree``), and asks in every further leaf within
a margin calibrated against brute force; there is no bound on the visits. Rows travel once per visited leaf as 16-bit
vectors; equal vectors are searched once and expanded afterwards; of a heavy leaf every pair of blocks of home rows and
asking rows is a group of its own.

Defined results: repeated rows count once; ids whose vector is null, empty, zero, not finite or of another length than
most have no neighbours; ties go to the smaller id; with fewer than k+1 usable ids all others are neighbours; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.llm import tree
from reportmill.llm.tree import TreeParams
from reportmill.llm.vectors import unpack, usable
from reportmill.runtime import materialize


@dataclass(frozen=True)
class NeighborParams:
    k: int = 5
    tree: TreeParams = field(default_factory=TreeParams)


def indexed(df: DataFrame, params: NeighborParams = NeighborParams(), key: str = "source_id", vector: str = "embedding") -> tuple[DataFrame, DataFrame, tree.Index | None]:
    """(single vectors (id, vec), copies (id, rep), their index or None if there is no usable row)."""
    base = usable(df, key, vector)
    copies = materialize(tree.copies(base), "copies")
    single = base.join(copies.select("id"), "id", "left_anti")
    return single, copies, tree.build(single, base.count(), params.tree, params.k)


def quality(df: DataFrame, params: NeighborParams = NeighborParams(), key: str = "source_id", vector: str = "embedding") -> DataFrame:
    """(n_leaves, margin, recall): the index and the share of the calibration queries' true neighbours, found by brute force, in the leaves they visit."""
    index = indexed(df, params, key, vector)[2]
    rows = [(len(index.tree.leaves), index.margin, index.recall)] if index else []
    return df.sparkSession.createDataFrame(rows, "n_leaves int, margin double, recall double")


def neighbors(df: DataFrame, params: NeighborParams = NeighborParams(), key: str = "source_id", vector: str = "embedding") -> DataFrame:
    """(id, neighbor, sim): the k most similar other ids of every id."""
    k = params.k
    single, copies, index = indexed(df, params, key, vector)
    if index is None:
        return df.sparkSession.createDataFrame([], "id string, neighbor string, sim double")

    def search(group: pa.Table) -> pa.Table:
        unit, ids = unpack(group.column("vec"), 16), np.array(group.column("id").to_pylist(), object)
        names, number = np.unique(ids, return_inverse=True)
        own = np.flatnonzero(group.column("target").to_numpy(zero_copy_only=False))
        _, first = np.unique(number[own], return_index=True)  # repeated rows once
        own = own[first]
        ask = np.flatnonzero(group.column("ask").to_numpy(zero_copy_only=False))
        _, first = np.unique(number[ask], return_index=True)
        ask = ask[first]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(ask) if len(own) else 0, 2048):
            q = ask[at : at + 2048]
            sims = unit[q] @ unit[own].T
            sims[number[q][:, None] == number[own][None, :]] = -2
            m = min(k, len(own))
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            value = np.take_along_axis(sims, top, axis=1)
            # equal values at the edge: take the smaller ids
            edge = np.flatnonzero((sims >= value.min(axis=1, keepdims=True)).sum(axis=1) > m)
            for e in edge:
                top[e] = np.lexsort((number[own], -sims[e]))[:m]
                value[e] = sims[e, top[e]]
            i, j = np.nonzero(value > -2)
            found.append((number[q][i], number[own][top[i, j]], value[i, j]))
        a, b, s = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int),) * 3
        order = np.argsort(a, kind="stable")
        a, b, s = a[order], b[order], s[order]
        cut = np.flatnonzero(np.diff(a, prepend=-1))
        lists = pa.ListArray.from_arrays(
            pa.array(np.append(cut, len(a)).astype(np.int32)),
            pa.StructArray.from_arrays([pa.array((-s).astype(np.float64)), pa.array(names[b] if len(b) else [], pa.string())], ["far", "neighbor"]),
        )
        return pa.table({"id": pa.array(names[a[cut]] if len(a) else [], pa.string()), "near": lists})

    each = tree.routed(single, index).groupBy("leaf", "home_block", "ask_block").applyInArrow(search, "id string, near array<struct<far:double,neighbor:string>>")
    best = each.groupBy("id").agg(F.flatten(F.collect_list("near")).alias("near"))  # a list of k for every group a row asks in
    found = best.select("id", F.explode(F.slice(F.array_sort(F.array_distinct("near")), 1, k)).alias("x")).select("id", "x.neighbor", (-F.col("x.far")).alias("sim"))
    return _expanded(found, copies, k)


def _expanded(found: DataFrame, copies: DataFrame, k: int) -> DataFrame:
    """``found`` among single vectors, made the k nearest ids of every id where ids share vectors.

    At most k+1 ids of a class of copies can be neighbours of one id; they are picked with a limit that acts before the shuffle.
    """
    if copies.isEmpty():
        return found
    reps = copies.select("rep").distinct()
    members = copies.select("rep", "id").union(reps.select("rep", F.col("rep").alias("id")))
    low = members.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("id"))).where(F.col("r") <= k + 1).select("rep", F.col("id").alias("member"))
    touched = reps.select(F.col("rep").alias("id"))
    # what each class (or single id) may have as neighbours: its own lowest ids at 1, and those of its neighbour classes
    options = found.join(low.withColumnRenamed("rep", "neighbor"), "neighbor", "left").select("id", F.coalesce("member", "neighbor").alias("neighbor"), "sim")
    options = options.union(low.select(F.col("rep").alias("id"), F.col("member").alias("neighbor"), F.lit(1.0).alias("sim")))
    w = Window.partitionBy("id").orderBy(F.desc("sim"), "neighbor")
    options = options.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r")
    alone = options.join(touched, "id", "left_anti")
    spread = members.join(options.withColumnRenamed("id", "rep"), "rep").select("id", "neighbor", "sim").where("id <> neighbor")
    ranked = alone.union(spread).withColumn("r", F.row_number().over(w))
    return ranked.where(F.col("r") <= k).drop("r")
