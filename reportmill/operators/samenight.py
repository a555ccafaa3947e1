"""Clusters of similar reports on one date, by average linkage on cosine distance."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.functions.text import word_safe
from reportmill.operators import vectors
from reportmill.operators.components import components
from reportmill.params import DEFAULT, Params
from reportmill.runtime import materialize, numbered


def average_linkage(distance: np.ndarray, threshold: float) -> np.ndarray:
    """A label per row: merges by average linkage while the distance is below the threshold (nearest-neighbour chain)."""
    n = len(distance)
    d = distance.astype(np.float64).copy()
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    merges: list[tuple[float, int, int]] = []
    chain: list[int] = []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.flatnonzero(alive)[0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        merges.append((float(d[a, b]), a, b))
        d[a] = d[:, a] = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a, a] = np.inf
        size[a] += size[b]
        alive[b] = False
    parent = list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for dist, a, b in sorted(merges):
        if dist < threshold:
            parent[root(b)] = root(a)
    for k in range(n):
        label[k] = root(k)
    return label


#: Reports of one date up to which they meet in one task; those of a busier date meet in pairs of blocks of this size.
BLOCK_ROWS = 2048


def _linked(rows: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """(source_id, part): parts of the busy dates that average linkage can't join: reports chained by distances below the threshold.

    Every pair of blocks of a date is a group, so groups are bounded; a group gives one link from each report to each set of the
    other block's reports it is chained to.
    """
    blocks = F.ceil(F.col("n") / BLOCK_ROWS).cast("int")
    placed = rows.join(sizes.where(F.col("n") > BLOCK_ROWS).select("event_date", blocks.alias("blocks")), "event_date")
    placed = placed.withColumn("own", F.pmod(F.xxhash64("source_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    placed = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "left": F.col("own") <= F.col("other")})

    def link(group: pa.Table) -> pa.Table:
        ids = np.array(group.column("source_id").to_pylist(), object)
        unit = vectors.scaled(group.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1))
        left = group.column("left").to_numpy(zero_copy_only=False).astype(bool)
        same = left.all()
        x, y = (np.flatnonzero(left), np.flatnonzero(left)) if same else (np.flatnonzero(left), np.flatnonzero(~left))
        label = np.arange(len(ids))
        a, b = [], []
        for at in range(0, len(x), 512):
            near = 1 - unit[x[at : at + 512]] @ unit[y].T < threshold
            for k, row in zip(x[at : at + 512].tolist(), near, strict=True):
                hit = y[row]
                hit = hit[label[hit] != label[k]]
                for v in np.unique(label[hit]).tolist():
                    a.append(ids[k])
                    b.append(ids[hit[label[hit] == v][0]])
                    label[label == v] = label[k]
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    found = placed.select("event_date", "i", "j", "left", "source_id", "embedding").groupBy("event_date", "i", "j").applyInArrow(link, "a string, b string")
    return components(found).select(F.col("node").alias("source_id"), F.col("label").alias("part"))


def members(reports: DataFrame, embeddings: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(event_date, cluster_key, source_id): members of clusters of the least size; the key is the smallest id.

    Dates with too few embedded reports are dropped before the shuffle by date. A date's reports meet in one task, which
    average linkage needs, up to ``BLOCK_ROWS`` of them. Two clusters only ever join over a pair below the threshold, so a busier
    date falls exactly into the parts its close pairs chain together, and each part is linked by itself; reports near no
    other are no part. A task then holds one such part, whose matrix is quadratic in its reports.
    """
    p = params
    rows = reports.where("event_date IS NOT NULL").select("source_id", "event_date").join(vectors.directed(embeddings), "source_id")
    counted = materialize(rows.groupBy("event_date").agg(F.count("*").alias("n")).where(F.col("n") >= p.night_min_reports), "dates")
    rows = rows.join(counted, "event_date").withColumn("part", F.lit(""))
    if not counted.where(F.col("n") > BLOCK_ROWS).isEmpty():
        rows = materialize(rows, "night_rows")
        parts = _linked(rows.drop("n", "part"), counted, p.night_distance)
        busy = rows.where(F.col("n") > BLOCK_ROWS).drop("part").join(parts, "source_id").select(*rows.columns)
        rows = rows.where(F.col("n") <= BLOCK_ROWS).unionByName(busy)

    def cluster(day: pa.Table) -> pa.Table:
        ids = np.array(day.column("source_id").to_pylist(), object)
        order = np.argsort(ids)
        unit = vectors.scaled(np.array(day.column("embedding").to_pylist(), np.float64))[order]
        ids = ids[order]
        label = average_linkage(1 - unit @ unit.T, p.night_distance)
        _, first, group, size = np.unique(label, return_index=True, return_inverse=True, return_counts=True)
        keep = size[group] >= p.night_min_size
        dates = day.column("event_date").combine_chunks().take(pa.array(np.flatnonzero(keep)))
        return pa.table({"event_date": dates, "cluster_key": pa.array(ids[first][group][keep], pa.string()), "source_id": pa.array(ids[keep], pa.string())})

    found = rows.drop("n").groupBy("event_date", "part").applyInArrow(cluster, "event_date date, cluster_key string, source_id string")
    return materialize(found, "nights")  # linked once, however often the members are used


def shape_counts(rows: DataFrame, by: list[str]) -> DataFrame:
    """(by, top_shape, shapes): the most frequent shape (ties: alphabetical) and a map of all with their counts; shapes are few."""
    n = rows.groupBy(*by, F.coalesce("shape_norm", F.lit("")).alias("shape_norm")).agg(F.count("*").alias("n"))
    entry = F.struct("shape_norm", "n")
    return n.groupBy(*by).agg(F.min_by("shape_norm", F.struct(-F.col("n"), "shape_norm")).alias("top_shape"), F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("shapes"))


def scored(found: DataFrame, reports: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per cluster: sizes, states, cities, shapes, mean similarity, score and the narrative nearest to the centre; numbered by score."""
    rows = found.join(reports.select("source_id", "state", "city", "shape_norm", "narrative"), "source_id").join(vectors.units(embeddings), "source_id")
    by = ["event_date", "cluster_key"]
    base = rows.groupBy(*by).agg(
        F.count("*").alias("n_reports"), F.countDistinct("state").alias("n_states"), F.countDistinct("city").alias("n_cities"),
        F.array_join(F.array_sort(F.collect_set("state")), ", ").alias("states"),
    )
    shape = shape_counts(rows, by)
    out = base.join(shape, by).join(vectors.coherence(rows, by).drop("n"), by).join(vectors.medoids(rows, by), by)
    out = out.join(reports.select(F.col("source_id").alias("medoid"), word_safe(F.col("narrative")).alias("representative_narrative")), "medoid")
    score = 0.3 * F.least(F.col("n_reports") / 10, F.lit(1.0)) + 0.3 * F.least(F.col("n_states") / 5, F.lit(1.0)) + 0.4 * F.col("coherence")
    out = out.withColumns({"mean_cosine_sim": F.round("coherence", 4), "score": F.round(score, 4)}).drop("coherence", "similarity")
    return numbered(out, [F.desc("score"), F.col("event_date"), F.col("cluster_key")], "cluster_id")


