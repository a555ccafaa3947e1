"""Canonical reports cleaned, with a log of every dropped row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reportmill.functions import dates, text
from reportmill.params import DEFAULT, Params
from reportmill.runtime import materialize


def judged(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """All rows with cleaned columns and ``reason``, the first rule a row fails, null if it passes all.

    Rules in order: time unreadable, narrative too short, not from the US, coordinates impossible (only if any row that
    passed so far has a latitude), year out of range. The texts are cleaned once: the rows are written to the shared folder
    before the flag for the fourth rule, a one-row join, is taken from them.
    """
    p = params
    rows = raw.withColumns({
        "event_dt": dates.parse_event(F.col("datetime")), "narrative": text.clean_narrative(F.col("comments")), "shape_norm": text.clean_shape(F.col("shape")),
        "state": text.code(F.col("state")), "country": text.code(F.col("country"), False), "latitude": F.col("latitude").try_cast("double"),
        "longitude": F.col("longitude").try_cast("double"), "duration_seconds": F.col("duration_seconds").try_cast("double"),
    })
    rows = rows.withColumns({"narrative_chars": F.char_length("narrative"), "event_year": F.year("event_dt")})
    american = (F.col("country") == "us") | F.col("state").isin(list(text.STATE_CODES)) if p.us_only else F.lit(True)
    early = (
        F.when(F.col("event_dt").isNull(), "unparseable_datetime").when(F.col("narrative_chars") < p.min_narrative, "narrative_too_short").when(~american, "non_us")
    )
    rows = materialize(rows.withColumn("early", early), "judged")
    flag = rows.where("early IS NULL").agg(F.coalesce(F.max(F.col("latitude").isNotNull()), F.lit(False)).alias("located"))
    rows = rows.crossJoin(F.broadcast(flag))  # exactly one row
    placed = F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))
    reason = F.coalesce("early", F.when(F.col("located") & ~placed, "invalid_coordinates").when(~F.col("event_year").between(p.first_year, p.last_year), "year_out_of_range"))
    return rows.withColumn("reason", reason).drop("early", "located")


def cleaned(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """The rows that pass all rules, with derived date columns; optional columns pass through where they exist."""
    keep = [c for c in ("tier1", "explanation") if c in raw.columns]
    return judged(raw, params).where("reason IS NULL").withColumns({"event_decade": dates.decade(F.col("event_year")), "event_date": F.to_date("event_dt")}).select(
        "source_id", "event_dt", "event_year", "event_decade", "event_date", "city", "state", "country", "latitude", "longitude", "shape", "shape_norm",
        "duration_seconds", "duration_hours", "narrative", "narrative_chars", "date_posted", *keep,
    )


def drops(raw: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """(source_id, reason) of the rows that fail a rule."""
    return judged(raw, params).where("reason IS NOT NULL").select("source_id", "reason")
