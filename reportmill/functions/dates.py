"""Date expressions with wall-clock semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_event(raw: Column) -> Column:
    """A report's time as timestamp_ntz: zone words are dropped and nothing is shifted.

    Month/day/year with two-digit years 00-29 in the 2000s, hours taken modulo 24; else ISO forms; else null.
    """
    s = F.regexp_replace(F.trim(raw), r"\s+(Local|Pacific|Eastern|Central|Mountain|UTC)$", "")
    us = r"^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})$"
    g = lambda i: F.regexp_extract(s, us, i)
    n = lambda i: F.when(g(i) != "", g(i).cast("int"))
    year = F.when(F.length(g(3)) == 2, n(3) + F.when(n(3) <= 29, 2000).otherwise(1900)).otherwise(n(3))
    made = F.try_make_timestamp_ntz(year, n(1), n(2), n(4) % 24, n(5), F.lit(0).cast("decimal(16,6)"))
    iso = F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2})?)?$"), s.try_cast("timestamp_ntz"))
    return F.when(s.rlike(us), made).otherwise(iso)


def decade(year: Column) -> Column:
    return (F.floor(year / 10) * 10).cast("int")


def year_bin(year: Column, size: int = 5) -> Column:
    return (F.floor(year / size) * size).cast("int")


def week_start(day: Column) -> Column:
    return F.date_trunc("week", day).cast("date")


def week_end(day: Column) -> Column:
    """The Sunday that labels the Monday-to-Sunday week of a day."""
    return F.date_add(week_start(day), 6)


def shifted_year(day: Column, last: int = 2026) -> Column:
    """A date beyond ``last`` is meant a century earlier."""
    return F.when(F.year(day) > last, F.add_months(day, -1200)).otherwise(day)
