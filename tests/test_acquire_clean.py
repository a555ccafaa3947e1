import pytest
from pyspark.sql import functions as F

from reportmill.operators import acquire, clean, geocode

V1 = ["datetime", "city", "state", "country", "shape", "duration (seconds)", "duration (hours/min)", "comments", "date posted", "latitude"]


@pytest.mark.parametrize(("columns", "name"), [
    ([*V1, "longitude "], "scrubbed_v1"), ([*V1, "longitude"], "scrubbed_v2"),
    (["date_time", "city", "state", "country", "shape", "duration", "text", "posted", "city_latitude", "city_longitude"], "renner_csv"),
    (["Sighting", "Occurred", "Location", "Shape", "Duration", "No of observers", "Reported", "Posted", "Characteristics", "Summary", "Text", "Location details", "Explanation"], "kcimc_v1"),
])
def test_detect(columns, name):
    assert acquire.detect_schema(columns) == name


def test_unknown_schema():
    with pytest.raises(ValueError, match="Could not identify schema"):
        acquire.detect_schema(["foo", "bar", "baz"])


def test_normalize_keeps_extras_and_gives_stable_ids(spark):
    df = spark.createDataFrame([("10/10/1949 20:30", "san marcos", "TX", "us", "cylinder", "2700", "45 min", "text", "4/27/2004", "29.88", "-97.94", "x")], [*V1, "longitude ", "tier1"])
    a, b = acquire.normalize(df, "scrubbed_v1").first(), acquire.normalize(df, "scrubbed_v1").first()
    assert a.source_id == b.source_id and len(a.source_id) == 16 and a.longitude == -97.94 and a.tier1 == "x" and a.duration_seconds == 2700.0


def test_normalize_clashing_extra_column(spark):
    df = spark.createDataFrame([("1/1/2000 10:00", "c", "TX", "us", "x", "1 min", "t", "p", "1", "2", "other")], ["date_time", "city", "state", "country", "shape", "duration", "text", "posted", "city_latitude", "city_longitude", "comments"])
    assert acquire.normalize(df, "renner_csv").first().comments == "t"


def test_location(spark):
    got = spark.createDataFrame([("Huntsville, TX, USA",), ("Portland, OR",), ("",), (None,)], "l string").select(*acquire.location_parts(F.col("l"))).collect()
    assert [tuple(r) for r in got] == [("Huntsville", "TX", "USA"), ("Portland", "OR", ""), ("", "", ""), ("", "", "")]


RAW = "source_id string, datetime string, city string, state string, country string, shape string, duration_seconds double, duration_hours string, comments string, date_posted string, latitude double, longitude double"
LONG = "A long enough narrative about a light in the sky."


def test_each_row_is_logged_once_at_the_first_rule(spark):
    rows = [
        ("ok", "1/1/2000 10:00", "c", "TX", None, "disk", None, None, LONG, None, 30.0, -97.0), ("dt", "garbage", "c", "TX", "us", None, None, None, "x", None, None, None),
        ("short", "1/1/2000 10:00", "c", "XX", "gb", None, None, None, None, None, None, None), ("far", "1/1/2000 10:00", "c", "XX", "gb", None, None, None, LONG, None, 1.0, 1.0),
        ("coord", "1/1/2000 10:00", "c", "tx", None, None, None, None, LONG, None, 95.0, 1.0), ("year", "1/1/1850 10:00", "c", "TX", "us", None, None, None, LONG, None, 1.0, 1.0),
    ]
    raw = spark.createDataFrame(rows, RAW)
    assert {r.source_id: r.reason for r in clean.drops(raw).collect()} == {"dt": "unparseable_datetime", "short": "narrative_too_short", "far": "non_us", "coord": "invalid_coordinates", "year": "year_out_of_range"}
    kept = clean.cleaned(raw).collect()
    assert [(r.source_id, r.shape_norm, r.event_decade) for r in kept] == [("ok", "disc", 2000)]


def test_coordinates_only_matter_if_any_are_there(spark):
    raw = spark.createDataFrame([("a", "1/1/2000 10:00", "c", "TX", "us", None, None, None, LONG, None, None, None)], RAW)
    assert clean.cleaned(raw).count() == 1 and clean.drops(raw).count() == 0


def test_clean_empty(spark):
    raw = spark.createDataFrame([], RAW)
    assert clean.cleaned(raw).count() == 0 and clean.drops(raw).count() == 0


def test_geocode_passes(spark):
    gaz = spark.createDataFrame([(2, "TX", "Austin city", "30.2", "-97.7"), (1, "TX", "austin", "1", "1"), (3, "MO", "Saint Louis city", "38.6", "-90.2"), (4, "OR", "Bend", "44", "-121"), (5, "TX", None, "1", "1"), (6, "TX", "Bad", "x", "1")], "place_id long, usps string, name string, intptlat string, intptlong string")
    centres = spark.createDataFrame([("TX", 31.5, -99.3), ("WA", 47.4, -120.4)], "state string, lat double, lon double")
    rows = [("a", "Austin", "TX"), ("b", "St. Louis (near)", "mo"), ("c", "Mount Bend", "OR"), ("d", "Nowhere", "WA"), ("e", "Nowhere", "ZZ"), ("f", None, None)]
    reports = spark.createDataFrame(rows, "source_id string, city string, state string").withColumn("latitude", F.lit(0.0))
    got = geocode.geocoded(reports, geocode.gazetteer(gaz), centres).collect()
    assert {r.source_id: (r.geocode_method, r.latitude) for r in got} == {"a": ("exact", 1.0), "b": ("exact", 38.6), "c": ("fuzzy", 44.0), "d": ("state_centroid", 47.4), "e": (None, None), "f": (None, None)}


def test_scrape_join(spark):
    detail = spark.createDataFrame([(1, "1/1/2000 10:00", "Austin, TX, USA", "disk", "1 min", "text", None), (2, None, None, None, None, None, None)], "sighting_id long, occurred string, location string, shape string, duration string, narrative string, posted string")
    index = spark.createDataFrame([("1", "x", "c", "s", "u", "y", "sum", "r1", True, "Aircraft"), ("2", "2/2/2002 2:02", "c", "s", "u", "y", "sum", "r2", None, None)], "sighting_id string, occurred string, city string, state string, country string, shape string, summary string, reported string, is_tier1 boolean, explanation string")
    a, b = acquire.scrape_joined(detail, index).orderBy("datetime").collect()
    assert (a.city, a.date_posted, a.tier1, a.comments) == ("Austin", "r1", True, "text") and (b.datetime, b.city, b.tier1, b.comments) == ("2/2/2002 2:02", "c", False, "sum")
