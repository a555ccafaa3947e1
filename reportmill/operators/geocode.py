"""Coordinates by lookup in three passes: exact, name variants, state centre."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reportmill.functions import text
from reportmill.runtime import BROADCAST_ROWS, materialize, small


def gazetteer(*tables: DataFrame) -> DataFrame:
    """(name, state, lat, lon): the union of the tables (earlier ones win), one row per name and state (then the smaller place)."""
    parts = [
        t.select(text.gazetteer_name(F.col("name")).alias("name"), F.trim("usps").alias("state"), F.trim("intptlat").try_cast("double").alias("lat"), F.trim("intptlong").try_cast("double").alias("lon"), F.lit(k).alias("src"), F.col("place_id").alias("line"))
        for k, t in enumerate(tables)
    ]
    every = reduce(DataFrame.unionByName, parts).where("name IS NOT NULL AND state IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL")
    w = Window.partitionBy("name", "state").orderBy("src", "line")
    return every.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn", "src", "line")


def geocoded(reports: DataFrame, places: DataFrame, centres: DataFrame, saints: bool = True) -> DataFrame:
    """``reports`` with latitude, longitude and geocode_method replaced by what the passes find.

    The lookup tables are broadcast while small, so rows are not shuffled.
    """
    city = text.normalize_city(F.col("city"), saints)
    places = materialize(places, "places")
    few = places.count() <= BROADCAST_ROWS
    near = F.broadcast if few else lambda df: df
    out = reports.drop("latitude", "longitude", "geocode_method").withColumns({"_s": text.code(F.col("state")), **{f"_v{k}": v for k, v in enumerate(text.city_variants(city))}})
    for k in range(3):
        side = near(places.select(F.col("name").alias(f"_v{k}"), F.col("state").alias("_s"), F.col("lat").alias(f"_lat{k}"), F.col("lon").alias(f"_lon{k}")))
        out = out.join(side, [f"_v{k}", "_s"], "left")
    out = out.join(small(centres.select(F.col("state").alias("_s"), F.col("lat").alias("_latc"), F.col("lon").alias("_lonc"))), "_s", "left")
    found = [f"_lat{k} IS NOT NULL" for k in range(3)]
    method = F.expr(f"CASE WHEN {found[0]} THEN 'exact' WHEN {found[1]} OR {found[2]} THEN 'fuzzy' WHEN _latc IS NOT NULL THEN 'state_centroid' END")
    return out.select(
        *[c for c in reports.columns if c not in ("latitude", "longitude", "geocode_method")],
        F.coalesce("_lat0", "_lat1", "_lat2", "_latc").alias("latitude"), F.coalesce("_lon0", "_lon1", "_lon2", "_lonc").alias("longitude"), method.alias("geocode_method"),
    )


def unmatched(located: DataFrame, n: int = 20) -> DataFrame:
    """The most frequent cities that got no place of their own."""
    rest = located.where("geocode_method IS NULL OR geocode_method = 'state_centroid'")
    return rest.groupBy("city", "state").agg(F.count("*").alias("n_reports")).orderBy(F.desc("n_reports"), "city", "state").limit(n)
