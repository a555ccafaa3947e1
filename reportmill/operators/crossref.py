"""Records of a second dataset against reports near in time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.functions import dates
from reportmill.functions.text import title_case
from reportmill.params import DEFAULT, Params


#: Forms of dates, tried in this order.
DATE_FORMS = ("M/d/yy", "M/d/yyyy", "yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss", "MMM d, yyyy", "MMMM d, yyyy", "d MMM yyyy", "d MMMM yyyy")


def incident_date(raw: Column) -> Column:
    """A date written in any of ``DATE_FORMS``, N/A and all else as null, years beyond 2026 a century earlier."""
    text = F.when(F.upper(F.trim(raw)) != "N/A", F.trim(raw))
    return dates.shifted_year(F.coalesce(*[F.try_to_timestamp(text, F.lit(form)) for form in DATE_FORMS]).cast("date"))


def incident_place(raw: Column, names: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(city, state) of a location text; both empty for a null and for a place in none of ``names`` (state name, code).

    "City, ST" with a capital code at the end; else the first state of ``names`` whose name the text holds, in any case, what is
    left being the city; else the first code, by alphabet, after a comma or at the end.
    """
    s, none = F.trim(raw), F.lit("")
    codes = sorted(c for _, c in names)
    listed = F.regexp_extract(s, r"^(.+?),\s*([A-Z]{2})$", 2).isin(codes)
    out_city, out_state = none, none
    for c in reversed(codes):
        here = s.contains(f", {c}") | s.endswith(f" {c}")
        out_city = F.when(here, F.trim(F.replace(F.replace(s, F.lit(f", {c}"), none), F.lit(f" {c}"), none))).otherwise(out_city)
        out_state = F.when(here, c).otherwise(out_state)
    low = F.lower(s)
    for name, c in reversed(names):
        here = low.contains(name.lower())
        out_city = F.when(here, title_case(F.regexp_replace(F.replace(low, F.lit(name.lower()), none), "^[ ,]+|[ ,]+$", ""))).otherwise(out_city)
        out_state = F.when(here, c).otherwise(out_state)
    first = F.trim(F.regexp_extract(s, r"^(.+?),\s*([A-Z]{2})$", 1))
    city, state = F.when(listed, first).otherwise(out_city), F.when(listed, F.regexp_extract(s, r"^(.+?),\s*([A-Z]{2})$", 2)).otherwise(out_state)
    return F.coalesce(F.when(raw.isNotNull(), city), none), F.coalesce(F.when(raw.isNotNull(), state), none)


def incident_state(raw: Column, names: list[tuple[str, str]]) -> Column:
    """The state of ``incident_place``, null where there is none."""
    return F.nullif(incident_place(raw, names)[1], F.lit(""))


def days_around(records: DataFrame, day: str, k: int) -> DataFrame:
    """Each record once per day within ``k`` days of its own, so that a window join becomes an equi-join."""
    return records.where(F.col(day).isNotNull()).withColumn("near_day", F.explode(F.expr(f"sequence(date_sub({day}, {k}), date_add({day}, {k}), interval 1 day)")))


def same_state(records: DataFrame, reports: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(record_id, n_reports, first_day, last_day, shapes): reports of the record's state within the window; records without any are left out.

    Reports are counted per state, day and shape first, so a busy day is one row when it meets its records.
    """
    daily = reports.where("state <> '' AND event_date IS NOT NULL").groupBy("state", F.col("event_date").alias("near_day"), "shape_norm").agg(F.count("*").alias("n"))
    met = days_around(records, "incident_date", params.window_days).join(daily, ["state", "near_day"])
    shapes = F.array_join(F.slice(F.array_sort(F.collect_set(F.when(F.col("shape_norm") != "", F.col("shape_norm")))), 1, 5), ", ")
    return met.groupBy("record_id", "state", "incident_date").agg(F.sum("n").alias("n_reports"), F.min("near_day").alias("first_day"), F.max("near_day").alias("last_day"), shapes.alias("shapes"))


def any_state(records: DataFrame, reports: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(record_id, n_reports, n_states): reports of any state within the narrow window, where there are enough."""
    daily = reports.where("event_date IS NOT NULL").groupBy(F.col("event_date").alias("near_day"), "state").agg(F.count("*").alias("n"))
    met = days_around(records, "incident_date", params.dense_days).join(daily, "near_day")
    out = met.groupBy("record_id", "incident_date").agg(F.sum("n").alias("n_reports"), F.countDistinct(F.when(daily["state"] != "", daily["state"])).alias("n_states"))
    return out.where(F.col("n_reports") >= params.dense_reports)
