"""Raw extracts brought to the canonical columns with a stable id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.params import DEFAULT, Params

CANONICAL = ("datetime", "city", "state", "country", "shape", "duration_seconds", "duration_hours", "comments", "date_posted", "latitude", "longitude")

#: The header variants in circulation and the canonical column of each header.
HEADER_VARIANTS = {
    "scrubbed_v1": {
        "datetime": "datetime", "city": "city", "state": "state", "country": "country", "shape": "shape", "duration (seconds)": "duration_seconds",
        "duration (hours/min)": "duration_hours", "comments": "comments", "date posted": "date_posted", "latitude": "latitude", "longitude ": "longitude",
    },
    "scrubbed_v2": {
        "datetime": "datetime", "city": "city", "state": "state", "country": "country", "shape": "shape", "duration (seconds)": "duration_seconds",
        "duration (hours/min)": "duration_hours", "comments": "comments", "date posted": "date_posted", "latitude": "latitude", "longitude": "longitude",
    },
    "renner_csv": {
        "date_time": "datetime", "city": "city", "state": "state", "country": "country", "shape": "shape", "duration": "duration_hours", "text": "comments",
        "posted": "date_posted", "city_latitude": "latitude", "city_longitude": "longitude",
    },
    "kcimc_v1": {
        "Sighting": "_sighting_id", "Occurred": "datetime", "Shape": "shape", "Duration": "duration_hours", "Text": "comments", "Posted": "date_posted",
        "Summary": "_summary", "Characteristics": "_characteristics", "Explanation": "explanation",
    },
}


def detect_schema(columns: list[str], params: Params = DEFAULT) -> str:
    """The header variant most columns belong to; the first of equals; an error below the least overlap."""
    best = max(HEADER_VARIANTS, key=lambda v: len(set(HEADER_VARIANTS[v]) & set(columns)))
    if len(set(HEADER_VARIANTS[best]) & set(columns)) < params.schema_overlap:
        raise ValueError(f"Could not identify schema of columns {columns}")
    return best


def location_parts(location: Column) -> list[Column]:
    """City, state and country of a text like "City, ST, Country"; what is missing is empty."""
    parts = F.transform(F.split(F.coalesce(location, F.lit("")), ","), lambda x: F.trim(x))
    return [F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit("")) for i in (1, 2, 3)]


def source_id(params: Params = DEFAULT) -> Column:
    """Hash of time, city, state and the start of the comments; nulls count as the text nan."""
    s = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("nan"))
    joined = F.concat_ws("|", s("datetime"), s("city"), s("state"), F.substring(s("comments"), 1, params.id_prefix))
    return F.substring(F.sha1(joined), 1, params.id_length)


def normalize(df: DataFrame, schema: str, params: Params = DEFAULT) -> DataFrame:
    """Renamed to canonical columns, missing ones null, extra ones kept, with ``source_id``; a clashing extra column gives way."""
    names = HEADER_VARIANTS[schema]
    out = df
    if schema == "kcimc_v1" and "Location" in df.columns:
        city, state, country = location_parts(F.col("Location"))
        out = out.withColumns({"city": city, "state": state, "country": country})
    taken = set(names.values())
    keep = [F.col(f"`{c}`").alias(names.get(c, c)) for c in out.columns if c in names or c not in taken]
    out = out.select(*keep)
    out = out.withColumns({c: F.lit(None).cast("string") for c in CANONICAL if c not in out.columns})
    out = out.withColumns({c: F.col(c).try_cast("double") for c in ("duration_seconds", "latitude", "longitude")})
    extra = [c for c in out.columns if c not in CANONICAL and c != "source_id"]
    return out.select(source_id(params).alias("source_id"), *CANONICAL, *extra)


def scrape_joined(detail: DataFrame, index: DataFrame, params: Params = DEFAULT) -> DataFrame:
    """Detail records with what the index knows about them; a detail value counts unless it is null."""
    d, i = detail.alias("d"), index.alias("i")
    both = d.join(i, F.col("d.sighting_id").try_cast("long") == F.col("i.sighting_id").try_cast("long"), "left")

    def pick(a: str, b: str) -> Column:
        have = [F.col(f"d.{a}")] if a in detail.columns else []
        have += [F.col(f"i.{b}")] if b in index.columns else []
        return F.coalesce(*[c.cast("string") for c in have]) if have else F.lit(None).cast("string")

    city, state, country = location_parts(pick("location", "location"))
    has = lambda c: F.col(f"i.{c}") if c in index.columns else F.lit(None)
    out = both.select(
        pick("occurred", "occurred").alias("datetime"), F.coalesce(F.nullif(city, F.lit("")), has("city")).alias("city"), F.coalesce(F.nullif(state, F.lit("")), has("state")).alias("state"),
        F.coalesce(F.nullif(country, F.lit("")), has("country")).alias("country"), pick("shape", "shape").alias("shape"), F.lit(None).cast("double").alias("duration_seconds"),
        pick("duration", "duration").alias("duration_hours"), pick("narrative", "summary").alias("comments"), pick("posted", "reported").alias("date_posted"),
        F.lit(None).cast("double").alias("latitude"), F.lit(None).cast("double").alias("longitude"), F.coalesce(has("is_tier1").cast("boolean"), F.lit(False)).alias("tier1"), has("explanation").cast("string").alias("explanation"),
    )
    return out.withColumn("source_id", source_id(params))
