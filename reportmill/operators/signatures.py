"""Distinctive phrases of groups of reports by TF-IDF.

Texts are tokenised once for the vocabulary and those of members once more for all groups. n-grams stay within a report.
Vocabularies are bounded by ``features``, so the term tables may be broadcast; the background of a group is the corpus totals
minus the group, never a scan of its own.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text
from reportmill.params import DEFAULT, Params
from reportmill.runtime import materialize, small

#: Words left out before n-grams are built.
STOP_WORDS = (
    "the", "and", "a", "an", "of", "to", "in", "it", "is", "was", "were", "be", "been", "at", "by", "for", "from", "with", "on", "as", "that", "this", "then",
    "than", "but", "or", "not", "no", "so", "if", "we", "our", "us", "my", "me", "he", "she", "his", "her", "they", "them", "their", "its", "you", "your",
    "had", "has", "have", "did", "do", "does", "there", "here", "when", "while", "which", "who", "what", "would", "could", "should", "will", "can", "all", "some",
)


def grams(reports: DataFrame, low: int, high: int, stop: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """(source_id, term): every n-gram occurrence of every narrative."""
    return reports.select("source_id", F.explode(_per_text(F.coalesce(F.col("narrative"), F.lit("")), low, high, stop)).alias("term"))


def _per_text(narrative: Column, low: int, high: int, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    # bound through a lambda, so a text is tokenised once and not once per n-gram
    return F.flatten(F.transform(F.array(text.tokens(narrative, list(stop))), lambda w: text.ngrams(w, low, high)))


def _marked(texts: Column, low: int, high: int) -> Column:
    """(term, fresh) for every n-gram occurrence of several texts; ``fresh`` marks one of each term."""
    in_order = F.sort_array(F.flatten(F.transform(texts, lambda t: _per_text(t, low, high))))
    mark = lambda g: F.transform(g, lambda x, i: F.struct(x.alias("term"), F.coalesce(F.get(g, i - 1) != x, F.lit(True)).alias("fresh")))
    return F.flatten(F.transform(F.array(in_order), mark))


def vocabulary(occurrences: DataFrame, features: int) -> DataFrame:
    """(term, total): the terms of highest total count (ties: alphabetical)."""
    return occurrences.groupBy("term").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "term").limit(features)


def signatures(reports: DataFrame, members: DataFrame, group: str, params: Params = DEFAULT, low: int = 2, high: int = 3, phrases: int | None = None) -> DataFrame:
    """(group, phrase, distinctiveness, group_count, rate_pct, n_reports): phrases of a group against all other reports.

    ``members``: (group, source_id). Scores are differences of two sublinear, smoothed, length-normalised TF-IDF rows, one
    of the group and one of the rest; only positive ones count. Groups below the least number of reports are left out.
    """
    p = params
    vocab = materialize(vocabulary(grams(reports, low, high), p.signature_features), "vocabulary")
    known = materialize(members.select(group, "source_id").distinct().join(reports.select("source_id"), "source_id", "left_semi"), "members")
    sizes = known.groupBy(group).agg(F.count("*").alias("n_reports")).where(F.col("n_reports") >= p.signature_min_reports)
    # texts travel, not their n-grams; those leave a text only if they are in the vocabulary
    own = reports.select("source_id", F.coalesce("narrative", F.lit("")).alias("narrative")).join(small(known.join(small(sizes), group)), "source_id")
    texts = own.groupBy(group, "n_reports", "source_id").agg(F.collect_list("narrative").alias("texts"))  # rows of one id
    inside = texts.select(group, "n_reports", F.explode(_marked(F.col("texts"), low, high)).alias("x")).select(group, "n_reports", "x.*")
    counts = inside.join(F.broadcast(vocab), "term").groupBy(group, "n_reports", "term", "total").agg(F.count("*").alias("e"), F.count_if("fresh").alias("docs"))
    one, two = math.log(1.5) + 1, 1.0
    idf = F.when(F.col("total") > F.col("e"), two).otherwise(one)
    rest = F.col("total") - F.col("e")
    scored = counts.withColumns({"we": (1 + F.log("e")) * idf, "wb": F.when(rest > 0, (1 + F.log(F.when(rest > 0, rest))) * idf).otherwise(0.0), "alone": (1 + F.log("total")) * one})
    base = vocab.agg(F.sum(F.pow((1 + F.log("total")) * one, F.lit(2))).alias("base"))
    of = Window.partitionBy(group)  # a group has at most ``features`` rows
    out = scored.withColumns({"ne": F.sqrt(F.sum(F.col("we") * F.col("we")).over(of)), "touched": F.sum(F.col("wb") * F.col("wb") - F.col("alone") * F.col("alone")).over(of)})
    out = out.crossJoin(F.broadcast(base))  # base is one row
    nb = F.sqrt(F.greatest(F.col("base") + F.col("touched"), F.lit(0.0)))
    out = out.withColumn("score", F.col("we") / F.col("ne") - F.when(nb > 0, F.col("wb") / nb).otherwise(0.0)).where("score > 1e-9")
    w = of.orderBy(F.desc(F.round("score", 6)), "term")
    top = out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= (phrases or p.signature_phrases))
    return top.select(
        group, F.col("term").alias("phrase"), F.round("score", 4).alias("distinctiveness"), F.col("docs").alias("group_count"), F.round(F.col("docs") * 100 / F.col("n_reports"), 2).alias("rate_pct"), "n_reports"
    )


def of_top_clusters(reports: DataFrame, members: DataFrame, params: Params = DEFAULT, top: int = 50, phrases: int = 10) -> DataFrame:
    """Phrases of the ``top`` clusters of (event_date, cluster_key, source_id) by size (ties: earlier date, smaller key), as ``signatures`` gives them by cluster_id, date and key."""
    first = members.groupBy("event_date", "cluster_key").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "event_date", "cluster_key").limit(top)
    name = F.concat_ws(" ", F.date_format("event_date", "yyyy-MM-dd"), "cluster_key")
    own = members.join(F.broadcast(first.drop("n")), ["event_date", "cluster_key"]).select(name.alias("cluster_id"), "source_id")  # at most ``top`` rows
    return signatures(reports, own, "cluster_id", params, phrases=phrases)


def class_terms(reports: DataFrame, members: DataFrame, group: str, params: Params = DEFAULT, top: int = 10) -> DataFrame:
    """(group, rank, term, tfidf): the top terms of each class, uni- and bigrams, each class one document; terms of one class only are left out."""
    p = params
    occ = grams(reports, 1, 2).join(members.select(group, "source_id").distinct(), "source_id")
    tf = occ.groupBy(group, "term").agg(F.count("*").alias("tf"))
    stats = tf.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).where(F.col("df") >= p.class_min_df)
    vocab = stats.orderBy(F.desc("total"), "term").limit(p.class_features)
    n = tf.agg(F.countDistinct(group).alias("n"))
    weighed = tf.join(F.broadcast(vocab), "term").crossJoin(F.broadcast(n)).withColumn("w", F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1))  # n is one row
    length = weighed.groupBy(group).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    scored = weighed.join(length, group).withColumn("tfidf", F.round(F.col("w") / F.col("length"), 6))
    w = Window.partitionBy(group).orderBy(F.desc("tfidf"), "term")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top).select(group, "rank", "term", F.round("tfidf", 4).alias("tfidf"))


def phrase_rates(reports: DataFrame, phrases: list[str]) -> DataFrame:
    """(phrase, docs, rate_pct): reports whose lower-cased narrative holds the phrase."""
    t = F.lower(F.coalesce(F.col("narrative"), F.lit("")))
    one = reports.agg(F.count("*").alias("n"), *[F.count_if(t.contains(p)).alias(f"c{k}") for k, p in enumerate(phrases)])
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"c{k}").alias("docs")) for k, p in enumerate(phrases)])
    return one.select("n", F.explode(pairs).alias("x")).select("x.phrase", "x.docs", F.when(F.col("n") > 0, F.round(F.col("x.docs") * 100 / F.col("n"), 4)).otherwise(0.0).alias("rate_pct"))


def lift(reports: DataFrame, members: DataFrame, group: str, phrases: list[str]) -> DataFrame:
    """(group, phrase, lift): rate of a phrase within the group over its rate in all reports; phrases never met are left out."""
    t = F.lower(F.coalesce(F.col("narrative"), F.lit("")))
    hits = [F.count_if(t.contains(p)).alias(f"c{k}") for k, p in enumerate(phrases)]
    every = reports.agg(F.count("*").alias("n0"), *[h.alias(f"a{k}") for k, h in enumerate(hits)])
    own = reports.join(members.select(group, "source_id").distinct(), "source_id").groupBy(group).agg(F.count("*").alias("n"), *hits)
    pairs = F.array(*[F.struct(F.lit(p).alias("phrase"), F.col(f"c{k}").alias("own"), F.col(f"a{k}").alias("total")) for k, p in enumerate(phrases)])
    long = own.crossJoin(F.broadcast(every)).select(group, "n", "n0", F.explode(pairs).alias("x"))  # every is one row
    return long.where("x.total > 0").select(group, "x.phrase", F.round((F.col("x.own") / F.col("n")) / (F.col("x.total") / F.col("n0")), 4).alias("lift"))
