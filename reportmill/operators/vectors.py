"""Group measures over embedding vectors."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector at length 1; null for null, empty and zero vectors."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b)))


def units(df: DataFrame, key: str = "source_id", vector: str = "embedding") -> DataFrame:
    """(key, unit): one row per key with a direction; repeated rows count once.

    The length is bound as a lambda variable, so it is computed once per row.
    """
    scaled = F.expr(f"transform(array(sqrt(aggregate({vector}, 0D, (s, x) -> s + double(x) * double(x)))), n -> CASE WHEN n > 0 THEN transform({vector}, x -> double(x) / n) END)[0]")
    return df.where(f"{key} IS NOT NULL AND size({vector}) > 0").select(key, scaled.alias("unit")).where("unit IS NOT NULL").groupBy(key).agg(F.first("unit").alias("unit"))


def directed(df: DataFrame, key: str = "source_id", vector: str = "embedding") -> DataFrame:
    """(key, vector): the rows ``units`` keeps with their vectors as stored, half as wide in a shuffle as units in doubles."""
    length = F.expr(f"sqrt(aggregate({vector}, 0D, (s, x) -> s + double(x) * double(x)))")
    return df.where(f"{key} IS NOT NULL AND size({vector}) > 0").where(length > 0).select(key, vector).groupBy(key).agg(F.first(vector).alias(vector))


def scaled(stored: np.ndarray) -> np.ndarray:
    """Vectors as rows, at length 1 to the bit as ``units`` gives them: squares are added in order."""
    v = stored.astype(np.float64)
    with np.errstate(invalid="ignore"):
        return v / np.sqrt(np.cumsum(v * v, axis=1)[:, -1:])


def coherence(members: DataFrame, group: list[str], default: float = 1.0) -> DataFrame:
    """(group, n, coherence): mean cosine over all pairs of a group's unit vectors, without forming pairs.

    For unit vectors it is (|sum|^2 - n) / (n (n - 1)); sums per dimension aggregate map-side. Groups of one get ``default``.
    """
    flat = members.select(*group, F.posexplode("unit").alias("i", "x"))
    sums = flat.groupBy(*group, "i").agg(F.sum("x").alias("s"), F.count("*").alias("n"))
    out = sums.groupBy(*group).agg(F.max("n").alias("n"), F.sum(F.col("s") * F.col("s")).alias("q"))
    return out.select(*group, "n", F.when(F.col("n") > 1, (F.col("q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))).otherwise(default).alias("coherence"))


def centroids(members: DataFrame, group: list[str]) -> DataFrame:
    """(group, centroid): the mean vector."""
    flat = members.select(*group, F.posexplode("unit").alias("i", "x")).groupBy(*group, "i").agg(F.avg("x").alias("x"))
    return flat.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("centroid"))


def medoids(members: DataFrame, group: list[str], key: str = "source_id") -> DataFrame:
    """(group, medoid, similarity): the member nearest to the centroid (ties: smaller key)."""
    near = members.join(centroids(members, group), group).withColumn("similarity", F.round(cosine(F.col("unit"), F.col("centroid")), 6))
    return near.groupBy(*group).agg(F.min_by(F.struct(key, "similarity"), F.struct(-F.col("similarity"), key)).alias("m")).select(*group, F.col(f"m.{key}").alias("medoid"), "m.similarity")
