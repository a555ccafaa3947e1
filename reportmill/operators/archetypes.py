"""Coarse groups of reports from their vectors, and a profile of each group."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import dates
from reportmill.operators import vectors
from reportmill.runtime import numbered, small


def assigned(embeddings: DataFrame, dims: int = 25, k: int = 30, min_size: int = 10, seed: int = 42) -> DataFrame:
    """(source_id, archetype, x, y): principal components, k-means on them, groups below ``min_size`` as -1; numbered by size.

    x and y are the first two components. Fewer rows than clusters give fewer clusters; an empty table gives no rows.
    """
    rows = vectors.units(embeddings).withColumn("v", array_to_vector("unit"))
    n = rows.count()
    if n < 2:
        return rows.select("source_id", F.lit(-1).alias("archetype"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    size = len(rows.first().unit)
    flat = PCA(k=min(dims, size), inputCol="v", outputCol="p").fit(rows).transform(rows)
    named = KMeans(k=min(k, n), seed=seed, featuresCol="p", predictionCol="c").fit(flat).transform(flat)
    counts = named.groupBy("c").agg(F.count("*").alias("n"), F.min("source_id").alias("low"))
    number = numbered(counts.where(F.col("n") >= min_size), [F.desc("n"), F.col("low")], "archetype").select("c", F.col("archetype").cast("int").alias("archetype"))
    p = vector_to_array("p")
    return named.join(small(number), "c", "left").select("source_id", F.coalesce("archetype", F.lit(-1)).alias("archetype"), F.round(p[0], 6).alias("x"), F.round(p[1] if size > 1 else F.lit(0.0), 6).alias("y"))


def profiles(labels: DataFrame, reports: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row per archetype but -1: size, share, shapes, peak decade, states, coherence and the most central report."""
    own = labels.where("archetype >= 0").groupBy("source_id").agg(F.min("archetype").alias("archetype"))
    rows = own.join(reports, "source_id")
    total = reports.agg(F.count("*").alias("total"))
    base = rows.groupBy("archetype").agg(F.count("*").alias("n_reports"), F.countDistinct(F.when(F.col("state") != "", F.col("state"))).alias("n_states"))
    shapes = rows.where("shape_norm <> ''").groupBy("archetype", "shape_norm").agg(F.count("*").alias("n"))
    w = Window.partitionBy("archetype").orderBy(F.desc("n"), "shape_norm")
    top = shapes.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("archetype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "shape_norm"))), lambda x: x["shape_norm"]), ", ").alias("top_3_shapes"))
    decade = rows.where("event_year IS NOT NULL").groupBy("archetype", dates.decade(F.col("event_year")).alias("d")).agg(F.count("*").alias("n")).groupBy("archetype").agg(F.max_by("d", F.struct("n", -F.col("d"))).alias("peak_decade"))
    placed = own.join(vectors.units(embeddings), "source_id")
    out = base.crossJoin(F.broadcast(total))  # total is one row
    out = out.join(top, "archetype", "left").join(decade, "archetype", "left").join(vectors.coherence(placed, ["archetype"]).drop("n"), "archetype", "left").join(vectors.medoids(placed, ["archetype"]), "archetype", "left")
    return out.select(
        "archetype", "n_reports", F.round(F.col("n_reports") * 100 / F.col("total"), 1).alias("pct_of_corpus"), F.split("top_3_shapes", ", ")[0].alias("top_shape"), "top_3_shapes", "peak_decade", "n_states",
        F.round("coherence", 4).alias("mean_cosine_sim"), "medoid",
    )
