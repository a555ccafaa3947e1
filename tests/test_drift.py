import json

from reportmill.operators import drift

SCHEMA = "file_id long, feed string, file_seq int, file_name string, acquired_at timestamp, row_no int, payload string, kind string, n long"


def raw(spark, files, more=()):
    out = []
    for fid, (feed, seq, lines) in enumerate(files, 1):
        out += [(fid, feed, seq, f"f{fid}", None, k, line if isinstance(line, (str, type(None))) else json.dumps(line), "clash", 1) for k, line in enumerate(lines, 1)]
    return spark.createDataFrame(out, SCHEMA)


def found(df):
    return sorted((r.file_id, r.field_name, r.change_kind) for r in drift.changes(df).collect())


def test_every_kind_of_change(spark):
    df = raw(spark, [
        ("a", 1, [{"id": 1, "longitude ": 1.5, "comments": "x", "extra": 1}, {"id": 2, "longitude ": None, "comments": "y"}]),
        ("a", 2, [{"id": "A", "Long": [1, 30.0], "comments": {"body": "x"}}, {"id": "B"}]),
        ("b", 1, [{"id": 1}]),
    ])
    assert found(df) == [
        (2, "comments", "type_changed"), (2, "extra", "removed"), (2, "longitude", "renamed"), (2, "longitude", "type_changed"), (2, "report_no", "type_changed"),
    ]


def test_majority_decides_the_kind_and_gaps_in_seq_are_bridged(spark):
    df = raw(spark, [("a", 1, [{"lat": 1}, {"lat": 2}, {"lat": "x"}, {"lat": None}]), ("a", 5, [{"lat": 1}, {"lat": "2"}, {"lat": "x"}])])
    assert found(df) == [(2, "latitude", "type_changed")]


def test_malformed_null_and_repeated_lines(spark):
    df = raw(spark, [("a", 1, [{"city": "X"}, None, "{bad", "[1]", {"city": "X"}, ""]), ("a", 2, [{"city": "X", "town2": True}])])
    assert found(df) == [(2, "town2", "added")]
    assert drift.unified(df).count() == df.count()


def test_nulls_never_change_type(spark):
    df = raw(spark, [("a", 1, [{"city": "X"}]), ("a", 2, [{"city": None}]), ("a", 3, [{"city": "Y"}])])
    assert found(df) == []


def test_a_header_that_takes_a_fields_place_by_its_values(spark):
    shapes = ["disc", "light", "orb", "cigar", "cone"]
    old = [{"id": k, "shape": shapes[k % 5], "city": f"c{k}"} for k in range(10)]
    new = [{"id": k, "gestalt": shapes[k % 5], "city": f"c{k}", "crew": k} for k in range(5, 15)]
    later = [{"id": k, "gestalt": shapes[k % 5], "shape": None} for k in range(15, 20)]
    df = raw(spark, [("a", 1, old), ("a", 2, new), ("a", 3, new), ("b", 1, [{"gestalt": "x"}])])
    assert found(df) == [(2, "crew", "added"), (2, "shape", "renamed")]
    assert {r["shape"] for r in drift.unified(df).where("file_id IN (2, 3)").collect()} == set(shapes)
    assert drift.unified(df).where("feed = 'b'").first()["other_fields"] == {"gestalt": "x"}
    assert found(raw(spark, [("a", 1, old), ("a", 2, [{"id": k, "x": k} for k in range(5, 15)])])) == [(2, "city", "removed"), (2, "shape", "removed"), (2, "x", "added")]
    # a second header of a field fills the gaps of the first
    got = drift.unified(raw(spark, [("a", 1, old), ("a", 2, new), ("a", 3, later)])).where("file_id = 3").collect()
    assert {r["shape"] for r in got} == set(shapes)


def test_routes_fold_the_steps(spark):
    df = raw(spark, [("a", 1, [{"city": "X", "lat": 1}]), ("a", 2, [{"town": "Y", "lat": "2"}]), ("a", 3, [{"town": "Z"}]), ("a", 4, [{"City": "W", "Lat": 3.5}])])
    reg = drift.registry(df)
    ops = {r.file_id: [(s.op, s.field) for s in r.steps] for r in reg.collect()}
    assert ops == {1: [("add", "city"), ("add", "latitude")], 2: [("rename", "city"), ("cast", "latitude")], 3: [("default", "latitude")], 4: [("rename", "city"), ("add", "latitude")]}
    assert {r.file_id: r.route for r in drift.routes(reg).collect()} == {1: {"city": ["city"], "latitude": ["lat"]}, 2: {"city": ["town"], "latitude": ["lat"]}, 3: {"city": ["town"]}, 4: {"city": ["City"], "latitude": ["Lat"]}}
    assert [(r.city, r.latitude) for r in drift.unified(df).orderBy("file_id").collect()] == [("X", 1.0), ("Y", 2.0), ("Z", None), ("W", 3.5)]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert found(df) == [] and drift.versions(df).count() == 0 and drift.unified(df).count() == 0


def test_values_are_cast_by_their_kind(spark):
    df = raw(spark, [("a", 1, [{"lon": [-117, 30.0], "duration (seconds)": "60", "Text": ["a", "b"]}, {"lon": {"deg": -5.5}, "Text": {"body": "c", "words": 1}, "moon": 1}, {"lon": " 7.25 ", "Text": "d"}, {"lon": "west"}])])
    got = drift.unified(df).orderBy("row_no").collect()
    assert [r.longitude for r in got] == [-117.5, -5.5, 7.25, None]
    assert [r.comments for r in got] == ["a b", "c", "d", None]
    assert got[0].duration_seconds == 60.0 and got[1].other_fields == {"moon": "1"} and got[0].city is None


def test_versions_count_changes_of_the_fingerprint(spark):
    df = raw(spark, [("a", 1, [{"city": "X"}]), ("a", 2, [{"city": "Z"}]), ("a", 3, [{"town": "Z"}])])
    assert [(r.file_id, r.version, r.steps) for r in drift.versions(df).orderBy("file_id").collect()] == [(1, 1, []), (2, 1, []), (3, 2, ["rename city -> town"])]


def test_header_rules(spark):
    heads = {"COMMENTS ": "comments", "report text": "comments", "witness_comments": "comments", "LONGITUDE_DEG": "longitude", "place longitude": "longitude", "long_dd": "longitude", "Lat": "latitude",
             "duration": "duration_hours", "duration (hours/min)": "duration_hours", "duration (seconds)": "duration_seconds", "Posted": "date_posted", "date_time": "datetime", "occurred_at": "datetime",
             "Sighting": "report_no", "town": "city", "n_observers": "n_observers", "reviewed": "reviewed", "weather_code": "weather_code"}
    got = spark.createDataFrame([(h,) for h in heads], "h string").select("h", drift.field_of(__import__("pyspark").sql.functions.col("h")).alias("f")).collect()
    assert {r.h: r.f for r in got} == heads
