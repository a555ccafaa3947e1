"""Timestamps in mixed formats, precisions and zones, made UTC instants.

All formats stand in one regex alternation with named groups. One replacement per value pulls every component out; the
calendar is checked and the instant assembled with integer day arithmetic inside generated code, without any UDF.

Defined results: null, blank and unreadable values, impossible dates or times, dates without a time where one is
needed, and local times that a daylight-saving change skips or repeats give null. Fractions of a second are cut off.
Where month-first and day-first are both possible the month stands first. Two-digit years 00-29 are 20xx, others 19xx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reportmill.runtime import small

#: Month names, zone words with their fixed offset in minutes, and zone words with daylight-saving rules.
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
FIXED_ZONES = {
    "z": 0, "utc": 0, "gmt": 0, "ut": 0, "est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360,
    "pst": -480, "pdt": -420, "akst": -540, "akdt": -480, "hst": -600,
}
RULED_ZONES = {"eastern": "America/New_York", "central": "America/Chicago", "mountain": "America/Denver", "pacific": "America/Los_Angeles"}

SPACES = r"[\s\u00a0\u2000-\u200b\u202f\u3000]+"
_MONTH = "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\\.?"
_DOW = "(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\\.?,? )?"
_DATES = (
    r"(?<y1>\d{4})[-/](?<m1>\d{1,2})[-/](?<d1>\d{1,2})",
    r"(?<y2>\d{4})(?<m2>\d{2})(?<d2>\d{2})(?:t?(?<h2>\d{2})(?<n2>\d{2})(?<s2>\d{2})|t(?<h3>\d{2})(?<n3>\d{2}))?",
    r"(?<a4>\d{1,2})(?:/(?<b4>\d{1,2})/|\.(?<b5>\d{1,2})\.|-(?<b6>\d{1,2})-)(?<y4>\d{4}|\d{2})",
    _DOW + rf"(?<m7>{_MONTH}) (?<d7>\d{{1,2}})(?:st|nd|rd|th)?,? (?<y7>\d{{4}})",
    _DOW + rf"(?<d8>\d{{1,2}})(?:st|nd|rd|th)?[ -](?:of )?(?<m8>{_MONTH})(?:,? |-)(?<y8>\d{{4}})",
)
_TIME = r"(?:(?:t| at |, at |, | )(?<h>\d{1,2})(?::(?<n>\d{2})(?::(?<s>\d{2})(?:[.,]\d+)?)?)? ?(?:(?<ap>[ap])\.?m\.?)?(?: ?(?:h|hrs?|hours?)\.?)?)?"
_ZONE = (
    r"(?: ?(?:(?<zf>z|utc|gmt|ut|[ecmp][sd]t|ak[sd]t|hst)|(?<zr>eastern|central|mountain|pacific)(?: (?:standard |daylight )?time)?|(?:utc|gmt)?"
    r"(?<zs>[+-])(?<zh>\d{2}):?(?<zm>\d{2})|local(?: time)?))?"
)
_COUNT = r"(?<u1>-?\d{9,10})|(?<u2>-?\d{11,13})|(?<u3>-?\d{15,16})"
_PATTERN = f"(?i)^(?:{_COUNT}|(?:{'|'.join(_DATES)}){_TIME}{_ZONE})$"
_FIELDS = (
    "u1", "u2", "u3", "y1,y2,y4,y7,y8", "m1,m2", "d1,d2,d7,d8", "m7,m8", "a4", "b4,b5,b6", "h,h2,h3", "n,n2,n3", "s,s2", "ap", "zf", "zr", "zs", "zh", "zm",
)


def parts(text: Column) -> Column:
    """The components of a timestamp text as an array of strings in the order of the fields above; null if no format fits."""
    plain = F.trim(F.regexp_replace(F.translate(text, "\u0001", " "), SPACES, " "))
    got = F.regexp_replace(plain, _PATTERN, "\u0001".join("".join(f"${{{g}}}" for g in f.split(",")) for f in _FIELDS))
    return F.when(got.contains("\u0001"), F.split(F.lower(got), "\u0001"))


def _days(y: str, m: str, d: str) -> str:
    """SQL for the days since 1970-01-01 of a date of the proleptic Gregorian calendar, in whole numbers."""
    yy = f"({y} - CASE WHEN {m} <= 2 THEN 1 ELSE 0 END)"
    doy = f"((153 * ({m} + CASE WHEN {m} > 2 THEN -3 ELSE 9 END) + 2) div 5 + {d} - 1)"
    return f"(365 * {yy} + {yy} div 4 - {yy} div 100 + {yy} div 400 + {doy} - 719468)"


def _month_days(y: str, m: str) -> str:
    return f"(CASE WHEN {m} IN (4, 6, 9, 11) THEN 30 WHEN {m} = 2 THEN CASE WHEN {y} % 4 = 0 AND ({y} % 100 <> 0 OR {y} % 400 = 0) THEN 29 ELSE 28 END ELSE 31 END)"


def _iso(u: str) -> str:
    day, sec = f"floor({u} / 86400)", f"pmod({u}, 86400)"
    two = lambda x: f"lpad(cast({x} AS string), 2, '0')"
    return f"concat(cast(date_from_unix_date(cast({day} AS int)) AS string), 'T', {two(f'{sec} div 3600')}, ':', {two(f'{sec} % 3600 div 60')}, ':', {two(f'{sec} % 60')}, 'Z')"


def instants(df: DataFrame, text: str, zone: str, date_alone: str | Column = "false") -> DataFrame:
    """``df`` with ``utc_seconds`` (long) and ``utc`` (string) of the text column.

    ``zone``: column with the zone id for values without one (null: such values are no instant).
    ``date_alone``: boolean column or SQL; where true, a date without a time means midnight.
    """
    num = lambda i: f"cast(nullif(_p[{i}], '') AS bigint)"
    out = df.withColumn("_p", parts(F.col(text))).withColumn("_alone", F.expr(date_alone) if isinstance(date_alone, str) else date_alone)
    month = "CASE " + " ".join(f"WHEN _p[6] LIKE '{m}%' THEN {i}" for i, m in enumerate(MONTHS, 1)) + " END"
    year = f"CASE WHEN length(_p[3]) = 2 THEN {num(3)} + CASE WHEN {num(3)} <= 29 THEN 2000 ELSE 1900 END ELSE {num(3)} END"
    out = out.selectExpr("*", f"{year} AS _y", f"coalesce({num(4)}, {month}) AS _m0", f"{num(5)} AS _d0", f"{num(7)} AS _a", f"{num(8)} AS _b", f"{num(9)} AS _h0", f"{num(10)} AS _n0", f"coalesce({num(11)}, 0) AS _s")
    first = f"_a BETWEEN 1 AND 12 AND _b BETWEEN 1 AND {_month_days('_y', '_a')}"
    out = out.selectExpr("*", f"CASE WHEN _a IS NULL THEN _m0 WHEN {first} THEN _a ELSE _b END AS _m", f"CASE WHEN _a IS NULL THEN _d0 WHEN {first} THEN _b ELSE _a END AS _d")
    hour = "CASE WHEN _p[12] = '' THEN _h0 WHEN _h0 BETWEEN 1 AND 12 THEN _h0 % 12 + CASE WHEN _p[12] = 'p' THEN 12 ELSE 0 END END"
    timed = "_h0 IS NOT NULL AND (_n0 IS NOT NULL OR _p[12] <> '')"
    alone = "_h0 IS NULL AND _alone AND _p[13] = '' AND _p[14] = '' AND _p[15] = ''"
    valid = f"_y >= 1 AND _m BETWEEN 1 AND 12 AND _d BETWEEN 1 AND {_month_days('_y', '_m')} AND (({timed} AND {hour} BETWEEN 0 AND 23 AND coalesce(_n0, 0) <= 59 AND _s <= 59) OR ({alone}))"
    out = out.selectExpr("*", f"CASE WHEN {valid} THEN {_days('_y', '_m', '_d')} * 86400L + coalesce({hour}, 0) * 3600 + coalesce(_n0, 0) * 60 + _s END AS _local")
    fixed = "CASE " + " ".join(f"WHEN _p[13] = '{z}' THEN {m}" for z, m in FIXED_ZONES.items())
    offset = f"{fixed} WHEN _p[15] <> '' AND {num(16)} <= 18 AND {num(17)} <= 59 THEN ({num(16)} * 60 + {num(17)}) * CASE WHEN _p[15] = '-' THEN -1 ELSE 1 END END"
    ruled = "CASE " + " ".join(f"WHEN _p[14] = '{w}' THEN '{z}'" for w, z in RULED_ZONES.items()) + f" WHEN _p[13] = '' AND _p[15] = '' THEN {zone} END"
    out = out.selectExpr("*", f"{offset} AS _offset", f"{ruled} AS _zone")
    out = out.selectExpr("*", "CASE WHEN _offset IS NULL THEN unix_seconds(to_utc_timestamp(timestamp_seconds(_local), _zone)) END AS _u")
    again = " OR ".join(f"unix_seconds(from_utc_timestamp(timestamp_seconds(_u + {k}), _zone)) = _local" for k in (1800, 3600, 7200, -1800, -3600, -7200))
    ruled_u = f"CASE WHEN unix_seconds(from_utc_timestamp(timestamp_seconds(_u), _zone)) = _local AND NOT ({again}) THEN _u END"
    count = f"coalesce({num(0)}, cast(floor({num(1)} / 1000) AS bigint), cast(floor({num(2)} / 1000000) AS bigint))"
    out = out.selectExpr("*", f"coalesce({count}, CASE WHEN _offset IS NOT NULL THEN _local - _offset * 60 ELSE {ruled_u} END) AS utc_seconds")
    # A generator is a fence: a later filter on the result isn't pushed through, and so copied into, all steps above.
    out = out.select(*df.columns, F.explode(F.array(F.struct("utc_seconds"))).alias("_done"))
    return out.select(*df.columns, "_done.utc_seconds", F.expr(_iso("_done.utc_seconds")).alias("utc"))


def report_instants(reports: DataFrame, states: DataFrame, posted_zone: str = "America/Los_Angeles") -> DataFrame:
    """(row_id, field_name, raw, utc_seconds, utc): both time fields of every report; utc is null where there is no single instant.

    ``datetime`` without a zone is in the zone of the row's state, ``date_posted`` in ``posted_zone``.
    The state table meets the rows in a broadcast join while it is small. A state code listed twice counts once.
    """
    zones = states.groupBy(F.upper(F.trim("state")).alias("_code")).agg(F.min("tz").alias("_tz")).where("_code IS NOT NULL")
    both = F.explode(F.array(*[F.struct(F.lit(n).alias("field_name"), F.col(n).alias("raw")) for n in ("datetime", "date_posted")])).alias("f")
    rows = reports.select("row_id", F.upper(F.trim(F.regexp_replace("state", SPACES, " "))).alias("_code"), both).select("row_id", "_code", "f.*").where("raw IS NOT NULL")
    rows = rows.join(small(zones), "_code", "left").selectExpr("row_id", "field_name", "raw", f"CASE WHEN field_name = 'date_posted' THEN '{posted_zone}' ELSE _tz END AS _tz")
    return instants(rows, "raw", "_tz", "field_name = 'date_posted'").drop("_tz")
