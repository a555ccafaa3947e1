"""Bursts of reports in a state against its yearly baseline, merged to flaps.

Everything is aggregation, windows over weeks (one row per state and week, however many reports) and range joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import dates
from reportmill.operators import vectors
from reportmill.params import DEFAULT, Params
from reportmill.runtime import materialize, numbered


def eligible(reports: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(source_id, state, event_date, city, shape_norm) of rows with a state and a date from the first year on."""
    return reports.where("state IS NOT NULL AND state <> '' AND event_date IS NOT NULL").where(F.year("event_date") >= params.flap_first_year).select("source_id", "state", "event_date", "city", "shape_norm")


def baselines(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(state, year, annual, baseline_weekly)."""
    return rows.groupBy("state", F.year("event_date").alias("year")).agg(F.count("*").alias("annual")).withColumn("baseline_weekly", F.col("annual") / params.weeks_per_year)


def weekly(rows: DataFrame) -> DataFrame:
    """(state, week_start, week_end, reports): Monday-to-Sunday weeks with at least one report."""
    day = F.col("event_date")
    return rows.groupBy("state", dates.week_start(day).alias("week_start"), dates.week_end(day).alias("week_end")).agg(F.count("*").alias("reports"))


def weekly_filled(rows: DataFrame) -> DataFrame:
    """As ``weekly``, with a zero row for every week without reports between a state's first and last."""
    weeks = weekly(rows)
    span = weeks.groupBy("state").agg(F.min("week_start").alias("a"), F.max("week_start").alias("b"))
    grid = span.select("state", F.explode(F.expr("sequence(a, b, interval 7 days)")).alias("week_start"))
    return grid.join(weeks.drop("week_end"), ["state", "week_start"], "left").select("state", "week_start", F.date_add("week_start", 6).alias("week_end"), F.coalesce("reports", F.lit(0)).alias("reports"))


def daily_filled(rows: DataFrame, flaps: DataFrame, margin: int = 14) -> DataFrame:
    """(state, start, day, reports): days around each flap, zeros included."""
    grid = flaps.select("state", "start", F.explode(F.expr(f"sequence(date_sub(start, {margin}), date_add(end, {margin}), interval 1 day)")).alias("day"))
    counts = rows.groupBy("state", F.col("event_date").alias("day")).agg(F.count("*").alias("reports"))
    return grid.join(counts, ["state", "day"], "left").select("state", "start", "day", F.coalesce("reports", F.lit(0)).alias("reports"))


def bursts(rows: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(state, week_start, week_end, reports, baseline_weekly, ratio): weeks with at least the ratio of the baseline of the year they end in."""
    p = params
    gated = rows.groupBy("state").agg(F.count("*").alias("n")).where(F.col("n") >= p.flap_state_gate).select("state")
    weeks = weekly(rows).where(F.col("reports") >= p.flap_week_gate).join(gated, "state", "left_semi").withColumn("year", F.year("week_end"))
    out = weeks.join(baselines(rows, p).drop("annual"), ["state", "year"]).where(F.col("baseline_weekly") >= p.flap_floor)
    out = out.withColumn("exact", F.col("reports") / F.col("baseline_weekly")).where(F.col("exact") >= p.flap_ratio)
    return out.select("state", "week_start", "week_end", "reports", F.round("baseline_weekly", 2).alias("baseline_weekly"), F.round("exact", 1).alias("ratio"))


def islands(weeks: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(state, start, end, flagged_reports, peak_ratio, baseline_weekly): bursts that start within the gap of the running end are one."""
    w = Window.partitionBy("state").orderBy("week_start")
    end = F.max("week_end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(F.col("week_start") <= F.date_add(end, params.flap_gap_days), 0).otherwise(1)
    grouped = weeks.withColumn("new", new).withColumn("island", F.sum("new").over(w))
    out = grouped.groupBy("state", "island").agg(
        F.min("week_start").alias("start"), F.max("week_end").alias("end"), F.sum("reports").alias("flagged_reports"), F.max("ratio").alias("peak_ratio"),
        F.min_by("baseline_weekly", "week_start").alias("baseline_weekly"),
    )
    return out.where(F.col("flagged_reports") >= params.flap_min_reports).drop("island")


def of_flap(rows: DataFrame, flaps: DataFrame) -> DataFrame:
    """The reports of each flap: equal state, date within; all reports count, flagged week or not."""
    # one row per burst: far fewer than the reports, so the optimizer sees by itself whether they can be broadcast
    return rows.join(flaps.select("state", "start", "end"), "state").where(F.col("event_date").between(F.col("start"), F.col("end")))


def half_life(rows: DataFrame, flaps: DataFrame) -> DataFrame:
    """(state, start, peak_date, half_life_days): days from the peak day (ties: first) to the first later reported day with at most half its reports.

    Null with fewer than three reported days (the peak is then the first day) or if it never falls so far.
    """
    days = of_flap(rows, flaps).groupBy("state", "start", "event_date").agg(F.count("*").alias("n"))
    peak = days.groupBy("state", "start").agg(F.max_by(F.struct("event_date", "n"), F.struct("n", -F.unix_date("event_date"))).alias("p"), F.min("event_date").alias("first"), F.count("*").alias("days"))
    fallen = days.join(peak, ["state", "start"]).where(F.col("event_date") > F.col("p.event_date")).where(F.col("n") <= F.col("p.n") / 2).groupBy("state", "start").agg(F.min("event_date").alias("half"))
    out = peak.join(fallen, ["state", "start"], "left")
    many = F.col("days") >= 3
    return out.select("state", "start", F.when(many, F.col("p.event_date")).otherwise(F.col("first")).alias("peak_date"), F.when(many, F.datediff("half", "p.event_date")).alias("half_life_days"))


def enriched(rows: DataFrame, flaps: DataFrame, embeddings: DataFrame | None = None) -> DataFrame:
    """Each flap with its report and city counts, duration, top shapes (ties: alphabetical) and decay.

    With embeddings also ``coherence``: the mean cosine over all pairs of its embedded reports, 0 for fewer than two.
    """
    inside = of_flap(rows, flaps)
    base = inside.groupBy("state", "start").agg(F.count("*").alias("n_reports"), F.countDistinct("city").alias("n_cities"))
    shapes = inside.where("shape_norm IS NOT NULL AND shape_norm <> ''").groupBy("state", "start", "shape_norm").agg(F.count("*").alias("n"))
    w = Window.partitionBy("state", "start").orderBy(F.desc("n"), "shape_norm")
    ranked = shapes.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("state", "start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "shape_norm"))), lambda x: x["shape_norm"]), ", ").alias("top_3_shapes")
    )
    out = flaps.join(base, ["state", "start"]).join(ranked, ["state", "start"], "left").join(half_life(rows, flaps), ["state", "start"], "left")
    more = []
    if embeddings is not None:
        alike = vectors.coherence(inside.join(vectors.units(embeddings), "source_id"), ["state", "start"], 0.0).drop("n")
        out = out.join(alike, ["state", "start"], "left")
        more = [F.round(F.coalesce("coherence", F.lit(0.0)), 4).alias("coherence")]
    return out.select(
        "state", "start", "end", "peak_date", "n_reports", (F.datediff("end", "start") + 1).alias("duration_days"), "peak_ratio", "baseline_weekly", "n_cities",
        F.split("top_3_shapes", ", ")[0].alias("top_shape"), "top_3_shapes", "half_life_days", *more,
    )


def concurrent(flaps: DataFrame) -> DataFrame:
    """(state, start, concurrent_states, n_concurrent_states): other flaps overlapping in time.

    Flaps are bucketed by the months they touch, so that overlap is an equi-join; the states of the pairs are collected (at most one per state).
    """
    months = flaps.select("state", "start", "end", F.explode(F.expr("sequence(trunc(start, 'month'), trunc(end, 'month'), interval 1 month)")).alias("m"))
    a, b = months.alias("a"), months.alias("b")
    touch = (F.col("a.m") == F.col("b.m")) & (F.col("a.start") <= F.col("b.end")) & (F.col("b.start") <= F.col("a.end")) & ~((F.col("a.state") == F.col("b.state")) & (F.col("a.start") == F.col("b.start")))
    pairs = a.join(b, touch).select(F.col("a.state").alias("state"), F.col("a.start").alias("start"), F.col("b.state").alias("other")).distinct()
    sets = pairs.groupBy("state", "start").agg(F.array_sort(F.collect_set("other")).alias("concurrent_states"))
    out = flaps.select("state", "start").join(sets, ["state", "start"], "left").withColumn("concurrent_states", F.coalesce("concurrent_states", F.array().cast("array<string>")))
    return out.withColumn("n_concurrent_states", F.size("concurrent_states"))


def catalog(rows: DataFrame, params: Params = DEFAULT, embeddings: DataFrame | None = None) -> DataFrame:
    """All flaps enriched, with their concurrent states, numbered by reports (ties: state, start)."""
    flaps = materialize(islands(bursts(rows, params), params), "flaps")
    out = enriched(rows, flaps, embeddings).join(concurrent(flaps), ["state", "start"])
    return numbered(out, [F.desc("n_reports"), F.col("state"), F.col("start")], "flap_id")


def threshold_grid(rows: DataFrame, ratios: list[float], params: Params = DEFAULT) -> DataFrame:
    """(ratio, n_weeks): weeks that exceed each of several ratios, in one job."""
    least = bursts(rows, Params(**{**params.__dict__, "flap_ratio": min(ratios)}))
    return least.select(F.explode(F.array(*map(F.lit, ratios))).alias("threshold"), "ratio").where("ratio >= threshold").groupBy("threshold").agg(F.count("*").alias("n_weeks"))
