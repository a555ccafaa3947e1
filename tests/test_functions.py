from datetime import date, datetime

from pyspark.sql import functions as F

from reportmill.functions import dates, text


def one(spark, values, expr):
    return [r[0] for r in spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").repartition(1).sortWithinPartitions("k").select(expr(F.col("x"))).collect()]


def test_event_times(spark):
    cases = {
        "10/10/1949 20:30": datetime(1949, 10, 10, 20, 30), "10/10/49 20:30": datetime(1949, 10, 10, 20, 30), "1/15/24 22:00": datetime(2024, 1, 15, 22), "12/31/29 23:59": datetime(2029, 12, 31, 23, 59),
        "1/1/30 00:00": datetime(1930, 1, 1), "garbage": None, "": None, None: None, "13/45/99 25:99": None, "2014-09-21 13:00:00 Local": datetime(2014, 9, 21, 13),
        "2014-10-23 11:11:17 Pacific": datetime(2014, 10, 23, 11, 11, 17), "2014-09-21 13:00:00": datetime(2014, 9, 21, 13), "1/1/2000 24:10": datetime(2000, 1, 1, 0, 10),
    }
    assert one(spark, list(cases), dates.parse_event) == list(cases.values())


def test_narratives(spark):
    cases = {
        "A plain sentence.": "A plain sentence.", "red&#44; green &apos;x&apos;": "red, green 'x'", "a\nb": "a\n\nb", "a\r\nb": "a\n\nb", "  a   b  ": "a b", None: "", "": "",
        "I saw it. Witness elects to remain totally anonymous; provides no contact information. PD": "I saw it.",
        "I saw it. Witness indicates that the date of the sighting is approximate. PD": "I saw it.", "I saw it. PD": "I saw it.", "I saw it.\nNUFORC Note: possible satellite": "I saw it.", "&amp;#44;": ",",
    }
    assert one(spark, list(cases), text.clean_narrative) == list(cases.values())


def test_shapes(spark):
    cases = {"triangle": "triangle", "round": "sphere", "disk": "disc", "changed": "changing", "TRIANGLE": "triangle", "  circle  ": "circle", None: ""}
    assert one(spark, list(cases), text.clean_shape) == list(cases.values())


def test_cities(spark):
    cases = {"Seattle (near)": "seattle", "St. Louis": "saint louis", "N. Bend": "bend", "Houston, TX": "houston", None: "", "West Linn": "linn"}
    assert one(spark, list(cases), text.normalize_city) == list(cases.values())


def test_ngrams_follow_stop_words(spark):
    got = one(spark, ["The red light over a barn", "red", "", None], lambda c: text.ngrams(text.tokens(F.coalesce(c, F.lit("")), ["the", "a"]), 2, 3))
    assert got == [["red light", "light over", "over barn", "red light over", "light over barn"], [], [], []]


def test_word_safe(spark):
    assert one(spark, ["short", "word " * 60], text.word_safe) == ["short", ("word " * 60)[:199] + "..."]


def test_weeks_end_on_sunday(spark):
    got = spark.sql("SELECT DATE '2024-01-01' AS a, DATE '2024-01-07' AS b, DATE '2024-01-08' AS c").select(*[dates.week_end(F.col(x)) for x in "abc"]).first()
    assert list(got) == [date(2024, 1, 7), date(2024, 1, 7), date(2024, 1, 14)]
