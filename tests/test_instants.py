import random
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import pytest

from reportmill.operators.instants import instants, report_instants

CASES = {
    "10/10/1949 20:30": "1949-10-11T01:30:00Z", "10/10/49 20:30": "1949-10-11T01:30:00Z", "1/15/24 22:00": "2024-01-16T03:00:00Z", "1/1/30 00:00": "1930-01-01T05:00:00Z",
    "2014-09-21 13:00:00 Local": "2014-09-21T17:00:00Z", "2014-10-23 11:11:17 Pacific": "2014-10-23T18:11:17Z", "2014-09-21 13:00:00 Eastern": "2014-09-21T17:00:00Z",
    "1969-12-31T23:59:59.999Z": "1969-12-31T23:59:59Z", "19500720T020500-0800": "1950-07-20T10:05:00Z", "Mon, 17 Oct 1955 12:32:00 GMT": "1955-10-17T12:32:00Z",
    "Dec 11, 1994 9:38 PM": "1994-12-12T02:38:00Z", "Dec 11, 1994 12:05 AM": "1994-12-11T05:05:00Z", "5 May 2012 at 21:55 hrs": "2012-05-06T01:55:00Z", "13.02.1996 17:50": "1996-02-13T22:50:00Z",
    "13/02/1996 17:50": "1996-02-13T22:50:00Z", "1/22/1999 5:43 PM CST": "1999-01-22T23:43:00Z", "1111839840": "2005-03-26T12:24:00Z", "1157338850785": "2006-09-04T03:00:50Z",
    " 2014-10-18 22:20:00  UTC ": "2014-10-18T22:20:00Z", "2/29/2000 00:00": "2000-02-29T05:00:00Z",
    "2004-05-05": None, "2/30/2009 21:00": None, "2/29/1900 10:00": None, "00/00/0000 00:00": None, "13/45/99 25:99": None, "6/17/ 21:30": None, "garbage": None, "": None, "about 9 pm": None,
    "3/12/2017 2:17": None, "11/5/2017 1:30": None, "2012-13-34": None, "12/25/1999 13:00 PM": None, None: None,
}


def test_vectors(spark):
    df = spark.createDataFrame([(k, "America/New_York") for k in CASES], "raw string, tz string")
    got = {r.raw: r.utc for r in instants(df, "raw", "tz").collect()}
    assert got == CASES


def test_against_python_for_random_wall_clocks(spark):
    rng = random.Random(1)
    zones = ["America/New_York", "America/Phoenix", "America/Anchorage", "Pacific/Honolulu", "America/Indiana/Indianapolis", "America/Los_Angeles"]
    times = [datetime(1950, 1, 1) + timedelta(minutes=rng.randrange(80 * 365 * 1440)) for _ in range(1500)]
    times += [datetime(y, m, d, h, 30) for y in range(1987, 2024) for m in (3, 4, 10, 11) for d in range(1, 16) for h in (1, 2)]
    cases = [(t.strftime("%Y-%m-%d %H:%M:%S"), rng.choice(zones)) for t in times]

    def expected(raw, zone):
        t, z = datetime.strptime(raw, "%Y-%m-%d %H:%M:%S"), ZoneInfo(zone)
        hits = {u for f in (0, 1) for u in [t.replace(tzinfo=z, fold=f).astimezone(timezone.utc)] if u.astimezone(z).replace(tzinfo=None) == t}
        return hits.pop().strftime("%Y-%m-%dT%H:%M:%SZ") if len(hits) == 1 else None

    got = instants(spark.createDataFrame(cases, "raw string, tz string"), "raw", "tz").collect()
    assert [(r.raw, r.tz, r.utc) for r in got if r.utc != expected(r.raw, r.tz)] == []


def test_zones_of_states_and_dates_alone(spark):
    states = spark.createDataFrame([("WA", "America/Los_Angeles"), ("WA", "America/Los_Angeles")], "state string, tz string")
    rows = [(1, "1/1/2000 10:00", " wa ", "1/2/2000"), (2, "1/1/2000 10:00", "XX", None), (3, "1/1/2000 10:00", None, "n/a"), (4, "2000-01-01", "WA", "20000102")]
    df = spark.createDataFrame(rows, "row_id long, datetime string, state string, date_posted string").selectExpr("*", "1 AS raw", "2 AS utc", "3 AS tz")
    got = {(r.row_id, r.field_name): r.utc for r in report_instants(df, states).collect() if r.utc}
    assert got == {(1, "datetime"): "2000-01-01T18:00:00Z", (1, "date_posted"): "2000-01-02T08:00:00Z", (4, "date_posted"): "2000-01-02T08:00:00Z"}


def test_empty(spark):
    rows = spark.createDataFrame([], "row_id long, datetime string, state string, date_posted string")
    assert report_instants(rows, spark.createDataFrame([], "state string, tz string")).count() == 0


@pytest.mark.parametrize("text", ["x" * 100_000, "1" * 5000, "1/1/2000 " + " " * 5000 + "10:00"])
def test_very_long_texts(spark, text):
    instants(spark.createDataFrame([(text, "UTC")], "raw string, tz string"), "raw", "tz").collect()
