"""Connected components by propagating minimum labels with joins; every round is a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.runtime import materialize


def components(edges: DataFrame, max_rounds: int = 30) -> DataFrame:
    """(node, label) for the links (a, b): label is the smallest node of the component.

    Alternating star steps: every node links its larger neighbours to the smallest it knows, then its smaller ones, until
    no link changes; a logarithmic number of rounds. The neighbours of a hub are never gathered in one place: minima are
    aggregated map-side and joined back, which adaptive execution splits. Null ends and self-links are ignored; nodes
    without a link do not appear.
    """
    now = materialize(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low2, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = materialize(small.where("a <> b").distinct(), "links")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if before == tuple(state):
            break
        before = tuple(state)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    ends = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
    return ends.union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
