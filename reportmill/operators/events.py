"""Reports, clusters, bursts and phrases against a catalog of known events. A catalog is broadcast while it is small."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.runtime import materialize, small

#: Name, first and last day, states (None: any), expected shape, expected phrases, kind.
CATALOG = (
    ("Phoenix Lights (1997)", "1997-03-10", "1997-03-20", ["AZ", "NV"], "triangle", ["phoenix lights", "white lights", "air force"], "unexplained"),
    ("Illinois Triangle (2000)", "2000-01-04", "2000-01-08", ["IL"], None, [], "unexplained"),
    ("Tinley Park IL (2004)", "2004-10-25", "2004-11-07", ["IL"], "light", ["red lights", "tinley park", "triangle formation"], "unexplained"),
    ("Stephenville TX (2008)", "2008-01-01", "2008-01-31", ["TX"], "light", ["fort worth", "miles away"], "unexplained"),
    ("O'Hare Airport (2006)", "2006-11-01", "2006-12-31", ["IL"], "disc", ["object hovering"], "unexplained"),
    ("Hudson Valley (1982-86)", "1982-01-01", "1986-12-31", ["NY", "CT", "NJ"], "triangle", ["white lights", "new york"], "unexplained"),
    ("Belgian Wave (1989-90)", "1989-11-01", "1990-04-30", None, None, [], "unexplained"),
    ("Trident Missile CA (2015)", "2015-11-07", "2015-11-09", ["CA", "AZ", "NV"], "light", ["navy missile", "missile launch"], "prosaic"),
    ("SpaceX Launch CA (2017)", "2017-12-22", "2017-12-24", ["CA", "AZ"], "light", ["vandenberg", "rocket launch"], "prosaic"),
    ("Leonid Meteors (1999)", "1999-11-16", "1999-11-19", None, "fireball", ["meteor shower"], "prosaic"),
    ("Starlink Trains (2020)", "2020-03-01", "2020-06-30", None, "formation", ["straight line", "evenly spaced", "single file"], "prosaic"),
    ("July 4th Lanterns (2012)", "2012-07-03", "2012-07-05", None, "fireball", ["watching fireworks", "bright orange"], "prosaic"),
    ("NJ Drones (2024-era reports)", "2023-06-01", "2023-12-31", ["NJ", "NY"], None, [], "unexplained"),
)


def catalog(spark: SparkSession, rows: tuple = CATALOG) -> DataFrame:
    day = dt.date.fromisoformat
    data = [(i, n, day(a), day(b), s, shape, list(p), k) for i, (n, a, b, s, shape, p, k) in enumerate(rows)]
    return spark.createDataFrame(data, "position int, event string, start date, end date, states array<string>, expected_shape string, expected_phrases array<string>, kind string")


def members(reports: DataFrame, events: DataFrame) -> DataFrame:
    """(event, source_id, state, shape_norm): reports within an event's days and, if it names any, its states."""
    e = small(events.select("event", "start", "end", F.col("states").alias("listed")))
    on = F.col("event_date").between(F.col("start"), F.col("end")) & (F.col("listed").isNull() | F.expr("array_contains(listed, state)"))
    return reports.join(e, on).select("event", "source_id", "state", "shape_norm")


def coverage(reports: DataFrame, events: DataFrame) -> DataFrame:
    """(event, corpus_reports, top_shape, shape_matches): also events without reports; no expected shape never matches."""
    inside = members(reports, events)
    n = inside.groupBy("event").agg(F.count("*").alias("corpus_reports"))
    top = inside.where("shape_norm <> ''").groupBy("event", "shape_norm").agg(F.count("*").alias("n")).groupBy("event").agg(F.min_by("shape_norm", F.struct(-F.col("n"), "shape_norm")).alias("top_shape"))
    out = events.join(n, "event", "left").join(top, "event", "left")
    return out.select("event", F.coalesce("corpus_reports", F.lit(0)).alias("corpus_reports"), "top_shape", F.coalesce(F.col("top_shape") == F.col("expected_shape"), F.lit(False)).alias("shape_matches"))


def clusters_met(clusters: DataFrame, reports: DataFrame, events: DataFrame) -> DataFrame:
    """(event, cluster_count, cluster_max_size): clusters dated within an event count if any member of any of them is in a listed state."""
    e = small(events.select("event", "start", "end", F.col("states").alias("listed")))
    m = clusters.join(reports.select("source_id", "state"), "source_id").join(e, F.col("event_date").between(F.col("start"), F.col("end")))
    size = m.groupBy("event", "event_date", "cluster_key").agg(F.count("*").alias("n"), F.bool_or(F.col("listed").isNull() | F.coalesce(F.expr("array_contains(listed, state)"), F.lit(False))).alias("here"))
    found = size.groupBy("event").agg(F.count("*").alias("cluster_count"), F.max("n").alias("cluster_max_size"), F.bool_or("here").alias("here")).where("here").drop("here")
    return events.select("event").join(found, "event", "left").na.fill(0)


def flaps_met(flaps: DataFrame, events: DataFrame) -> DataFrame:
    """(event, flap_count, flap_max_reports, flap_peak_ratio): flaps overlapping an event in a listed state."""
    e = events.select("event", F.col("start").alias("e0"), F.col("end").alias("e1"), F.col("states").alias("listed"))
    on = (F.col("start") <= F.col("e1")) & (F.col("e0") <= F.col("end")) & (F.col("listed").isNull() | F.expr("array_contains(listed, state)"))
    found = flaps.join(small(e), on).groupBy("event").agg(F.count("*").alias("flap_count"), F.max("n_reports").alias("flap_max_reports"), F.max("peak_ratio").alias("flap_peak_ratio"))
    return events.select("event").join(found, "event", "left").na.fill(0)


def phrases_met(signatures: DataFrame, events: DataFrame) -> DataFrame:
    """(event, sig_found, sig_phrases_matched, sig_top_phrase, sig_top_score): the phrases found for an event's like-named signatures.

    A signature belongs to an event if its name holds any of the first two words of the event's, in any case; of several the first
    in the catalog's order counts (those not in the catalog last, by name). Matched are expected phrases that are part of a found one.
    """
    names = signatures.select(F.col("event").alias("sig_event")).distinct().join(events.select(F.col("event").alias("sig_event"), "position"), "sig_event", "left")
    words = F.slice(F.split(F.lower("event"), r"\s+"), 1, 2)
    alike = F.exists(words, lambda w: F.lower("sig_event").contains(w))
    named = events.select("event", "expected_phrases").join(small(names), alike)
    first = named.groupBy("event", "expected_phrases").agg(F.min_by("sig_event", F.struct(F.coalesce("position", F.lit(1 << 30)), "sig_event")).alias("sig_event"))
    best = F.struct(-F.col("distinctiveness"), "phrase")
    got = signatures.groupBy(F.col("event").alias("sig_event")).agg(F.collect_list(F.lower("phrase")).alias("got"), F.min_by("phrase", best).alias("sig_top_phrase"), F.max("distinctiveness").alias("sig_top_score"))  # at most the top phrases
    met = first.join(got, "sig_event").select("event", F.size(F.filter("expected_phrases", lambda p: F.exists("got", lambda g: g.contains(F.lower(p))))).alias("sig_phrases_matched"), "sig_top_phrase", "sig_top_score")
    out = events.select("event").join(met, "event", "left")
    return out.select("event", F.col("sig_phrases_matched").isNotNull().alias("sig_found"), F.coalesce("sig_phrases_matched", F.lit(0)).alias("sig_phrases_matched"), F.coalesce("sig_top_phrase", F.lit("")).alias("sig_top_phrase"), F.coalesce("sig_top_score", F.lit(0.0)).alias("sig_top_score"))


def matrix(reports: DataFrame, events: DataFrame, clusters: DataFrame, flaps: DataFrame, signatures: DataFrame) -> DataFrame:
    """One row per event with what each of four methods finds, how many do, and what that makes of it: PASS from two on, PARTIAL for one, else MISS.

    The methods run one after the other and their rows are written: in one plan all their scans and broadcasts would be begun at once.
    """
    covered, met = materialize(coverage(reports, events), "coverage"), materialize(clusters_met(clusters, reports, events), "clusters_met")
    burst, said = materialize(flaps_met(flaps, events), "flaps_met"), materialize(phrases_met(signatures, events), "phrases_met")
    out = covered.join(met, "event").join(burst, "event").join(said, "event").join(events.select("event", "kind"), "event")
    hits = [F.col("cluster_count") > 0, F.col("flap_count") > 0, F.col("sig_found"), F.col("shape_matches")]
    n = sum((h.cast("int") for h in hits[1:]), hits[0].cast("int"))
    return out.withColumn("detections_out_of_4", n).withColumn("status", F.when(n >= 2, "PASS").when(n >= 1, "PARTIAL").otherwise("MISS"))


def verdicts(matrix_: DataFrame) -> DataFrame:
    """(kind, n_events, passed, partial, missed, pct_passed): totals per kind of event and, with a null kind, over all."""
    of = lambda s: F.count_if(F.col("status") == s)
    return matrix_.rollup("kind").agg(F.count("*").alias("n_events"), of("PASS").alias("passed"), of("PARTIAL").alias("partial"), of("MISS").alias("missed"), F.round(of("PASS") * 100 / F.count("*"), 1).alias("pct_passed"))
