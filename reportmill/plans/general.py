"""Queries of the general data problems (schema drift, instants) over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.operators import drift, instants
from reportmill.runtime import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return drift.changes(table(spark, folder, "raw_rows")).select("file_id", "field_name", "change_kind").distinct()


def p1_steps(spark: SparkSession, folder: str) -> DataFrame:
    """The migration steps of each version, as text."""
    return drift.versions(table(spark, folder, "raw_rows")).select("feed", "file_id", "version", "steps")


def p1_versions(spark: SparkSession, folder: str) -> DataFrame:
    return drift.versions(table(spark, folder, "raw_rows")).drop("steps")


def p1_unified(spark: SparkSession, folder: str) -> DataFrame:
    """All lines under the canonical columns; coordinates to six places."""
    out = drift.unified(table(spark, folder, "raw_rows"))
    return out.select("file_id", "row_no", *[F.round(c, 6).alias(c) if c in ("latitude", "longitude") else c for c in drift.CANONICAL])


def p1_other_fields(spark: SparkSession, folder: str) -> DataFrame:
    """What lines hold beside the canonical columns."""
    return drift.unified(table(spark, folder, "raw_rows")).select("file_id", "row_no", F.explode("other_fields").alias("field_name", "value"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = instants.report_instants(table(spark, folder, "nuforc"), table(spark, folder, "state_centroid"))
    return found.where("utc_seconds IS NOT NULL").select("row_id", "field_name", "utc")


QUERIES = {f.__name__: f for f in (p1_found, p1_versions, p1_steps, p1_unified, p1_other_fields, p2_found)}
_KIND = "CASE t WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'NULL' THEN NULL ELSE 'number' END"
#: Headers in circulation, trimmed and in small letters, by field. The SQL reads headers by this list alone.
_HEADERS = {
    "report_no": "id|sighting|report_no", "datetime": "datetime|date_time|occurred|occurred_at", "city": "city|town", "state": "state", "country": "country", "shape": "shape|shape_reported",
    "duration_seconds": "duration (seconds)|duration_seconds", "duration_hours": "duration|duration (hours/min)", "comments": "comments|text|narrative|report text|witness_comments",
    "date_posted": "posted|date posted|date_posted", "latitude": "latitude|lat|city_latitude", "longitude": "longitude|long|lon|long_dd|city_longitude|longitude_deg|place longitude",
}
_LIST = ", ".join(f"('{h}', '{f}')" for f, heads in _HEADERS.items() for h in heads.split("|"))
_FIELDS = rf"""l(head, field) AS (VALUES {_LIST}), e AS (SELECT feed, file_seq, file_id, row_no, payload::JSON AS j, unnest(json_keys(payload::JSON)) AS header FROM raw_rows WHERE json_valid(payload)),
h AS (SELECT e.*, coalesce(l.field, header) AS field_name, json_extract(j, '$."' || header || '"') AS v, json_type(json_extract(j, '$."' || header || '"')) AS t FROM e LEFT JOIN l ON l.head = trim(lower(header))),
hk AS (SELECT *, {_KIND} AS kind FROM h),
n AS (SELECT file_id, field_name, header, row_number() OVER (PARTITION BY file_id, field_name ORDER BY count(*) DESC, header) AS rn FROM hk GROUP BY 1, 2, 3),
m AS (SELECT file_id, field_name, kind, row_number() OVER (PARTITION BY file_id, field_name ORDER BY count(*) DESC, kind) AS rn FROM hk WHERE kind IS NOT NULL GROUP BY 1, 2, 3),
na AS (SELECT file_id, field_name, string_agg(header, '|' ORDER BY rn) AS headers FROM n GROUP BY 1, 2),
ff AS (SELECT n.file_id, n.field_name, n.header, na.headers, m.kind FROM n JOIN na USING (file_id, field_name) LEFT JOIN m ON n.file_id = m.file_id AND n.field_name = m.field_name AND m.rn = 1 WHERE n.rn = 1),
fo AS (SELECT feed, file_seq, file_id, lag(file_id) OVER (PARTITION BY feed ORDER BY file_seq, file_id) AS prev_id FROM (SELECT DISTINCT feed, file_seq, file_id FROM raw_rows)),
now AS (SELECT fo.file_id, ff.field_name, header, kind FROM fo JOIN ff USING (file_id) WHERE prev_id IS NOT NULL), old AS (SELECT fo.file_id, ff.field_name, header, kind FROM fo JOIN ff ON ff.file_id = fo.prev_id),
b AS (SELECT coalesce(now.file_id, old.file_id) AS file_id, coalesce(now.field_name, old.field_name) AS field_name, now.header AS h1, old.header AS h0, now.kind AS k1, old.kind AS k0 FROM now FULL JOIN old ON now.file_id = old.file_id AND now.field_name = old.field_name),
ch AS (SELECT file_id, field_name, 'added' AS change_kind FROM b WHERE h0 IS NULL UNION ALL SELECT file_id, field_name, 'removed' FROM b WHERE h1 IS NULL
UNION ALL SELECT file_id, field_name, 'renamed' FROM b WHERE h0 <> h1 UNION ALL SELECT file_id, field_name, 'type_changed' FROM b WHERE k0 <> k1)"""
#: Forms of local times, and of dates that stand alone, in the order they are tried; months before days.
_TIMES = (
    "%Y-%m-%d %H:%M:%S", "%Y-%m-%dT%H:%M:%S", "%Y%m%dT%H%M%S", "%m/%d/%Y %H:%M", "%d/%m/%Y %H:%M", "%m/%d/%Y %I:%M %p", "%B %d, %Y %I:%M %p", "%b %d, %Y %I:%M %p",
    "%d %B %Y %H:%M", "%d %b %Y %H:%M", "%d %b %Y %H:%M:%S", "%m.%d.%Y %H:%M", "%d.%m.%Y %H:%M",
)
_DAYS = ("%m/%d/%Y", "%d/%m/%Y", "%Y-%m-%d", "%B %d, %Y", "%b %d, %Y", "%d %B %Y", "%d %b %Y", "%Y%m%d")


def _forms(forms: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{f}'" for f in forms) + "]"


#: Instants by lists of time forms and the zone tables of the other engine.
_INSTANTS = rf"""f AS (SELECT row_id, 'datetime' AS field_name, datetime AS raw, (SELECT any_value(tz) FROM state_centroid c WHERE c.state = upper(trim(nuforc.state))) AS home FROM nuforc
  UNION ALL SELECT row_id, 'date_posted', date_posted, 'America/Los_Angeles' FROM nuforc),
p AS (SELECT *, trim(regexp_replace(raw, '[\s\x{{00a0}}]+', ' ', 'g')) AS x FROM f WHERE raw IS NOT NULL),
q AS (SELECT *, regexp_extract(x, ' (Local|Pacific|Eastern|Central|Mountain|UTC|GMT|[ECMP][SD]T)$', 1) AS word, CASE WHEN contains(x, ':') OR contains(x, 'T') THEN regexp_extract(x, '(?:\d| )(Z|[+-]\d\d:?\d\d)$', 1) ELSE '' END AS off FROM p),
r AS (SELECT *, trim(left(x, len(x) - len(word) - len(off))) AS b0 FROM q),
s AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(b0, '(:\d\d)\.\d+$', '\1'), '( hrs|h)$', ''), '(,| at) (\d+:\d+)$', ' \2'), '^[A-Z][a-z]{{2}}, ', '') AS b1 FROM r),
t AS (SELECT *, CASE WHEN regexp_matches(b1, '^\d+/\d+/\d\d( |$)') THEN regexp_replace(b1, '^(\d+/\d+/)(\d\d)', '\1' || CASE WHEN try_cast(regexp_extract(b1, '^\d+/\d+/(\d\d)', 1) AS INT) <= 29 THEN '20' ELSE '19' END || '\2') ELSE b1 END AS b FROM s),
u AS (SELECT *, coalesce(try_strptime(b, {_forms(_TIMES)}), CASE WHEN field_name = 'date_posted' AND word = '' AND off = '' THEN try_strptime(b, {_forms(_DAYS)}) END) AS wall,
  CASE word WHEN 'Eastern' THEN 'America/New_York' WHEN 'Central' THEN 'America/Chicago' WHEN 'Mountain' THEN 'America/Denver' WHEN 'Pacific' THEN 'America/Los_Angeles' WHEN 'UTC' THEN 'UTC' WHEN 'GMT' THEN 'UTC'
    ELSE CASE WHEN word IN ('', 'Local') AND off = '' THEN home END END AS zone,
  CASE WHEN off = 'Z' THEN 0 WHEN off <> '' THEN (CASE WHEN off[1] = '-' THEN -1 ELSE 1 END) * (cast(off[2:3] AS INT) * 60 + cast(right(off, 2) AS INT))
    WHEN regexp_matches(word, '^[ECMP][SD]T$') THEN -60 * (CASE word[1] WHEN 'E' THEN 5 WHEN 'C' THEN 6 WHEN 'M' THEN 7 ELSE 8 END - CASE WHEN word[2] = 'D' THEN 1 ELSE 0 END) END AS minutes FROM t),
v AS (SELECT *, CASE WHEN minutes IS NULL THEN epoch(timezone(zone, wall)) END AS e FROM u),
w AS (SELECT *, CASE WHEN timezone(zone, to_timestamp(e)) = wall AND timezone(zone, to_timestamp(e + 3600)) <> wall AND timezone(zone, to_timestamp(e - 3600)) <> wall THEN e END AS sure FROM v),
y AS (SELECT row_id, field_name, CASE WHEN regexp_matches(x, '^-?\d{{9,10}}$') THEN try_cast(x AS BIGINT) WHEN regexp_matches(x, '^-?\d{{11,13}}$') THEN cast(floor(try_cast(x AS BIGINT) / 1000) AS BIGINT)
  WHEN minutes IS NOT NULL THEN cast(epoch(wall) AS BIGINT) - minutes * 60 ELSE cast(sure AS BIGINT) END AS seconds FROM w)
SELECT row_id, field_name, strftime(make_timestamp(seconds * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS utc FROM y WHERE seconds IS NOT NULL"""
_TEXT = "CASE WHEN {0} IS NULL OR json_type({0}) = 'NULL' THEN NULL WHEN json_type({0}) = 'VARCHAR' THEN json_extract_string({0}, '$') ELSE cast({0} AS VARCHAR) END"
_PLAIN = ("report_no", "datetime", "city", "state", "country", "shape", "duration_hours", "date_posted")
SQL: dict[str, str] = {
    "p2_found": f"WITH {_INSTANTS}",
    "p1_found": f"WITH {_FIELDS} SELECT * FROM ch",
    "p1_versions": f"""WITH {_FIELDS}, fp AS (SELECT file_id, sha256(string_agg(field_name || chr(9) || headers || chr(9) || coalesce(kind, '-'), chr(10) ORDER BY field_name)) AS fingerprint, count(*) AS n_fields FROM ff GROUP BY 1),
v AS (SELECT feed, file_seq, file_id, coalesce(fingerprint, sha256('')) AS fingerprint, coalesce(n_fields, 0) AS n_fields FROM fo LEFT JOIN fp USING (file_id)), w AS (SELECT *, CASE WHEN fingerprint = lag(fingerprint) OVER (PARTITION BY feed ORDER BY file_seq, file_id) THEN 0 ELSE 1 END AS moved FROM v)
SELECT feed, file_id, file_seq, fingerprint, cast(sum(moved) OVER (PARTITION BY feed ORDER BY file_seq, file_id) AS BIGINT) AS version, n_fields FROM w""",
    "p1_unified": f"""WITH {_FIELDS}, x AS (SELECT hk.file_id, hk.row_no, hk.field_name, arg_min({_TEXT.format('v')}, n.rn) AS s FROM hk JOIN n USING (file_id, field_name, header) WHERE t <> 'NULL' GROUP BY 1, 2, 3),
y AS (SELECT file_id, row_no, {', '.join(f"max(s) FILTER (field_name = '{c}') AS {c}" for c in (*_PLAIN, 'duration_seconds', 'comments', 'latitude', 'longitude'))} FROM x GROUP BY 1, 2)
SELECT r.file_id, r.row_no, {', '.join(_PLAIN)}, try_cast(trim(duration_seconds) AS DOUBLE) AS duration_seconds,
CASE WHEN comments LIKE '[%' AND json_valid(comments) THEN array_to_string(from_json(comments, '["VARCHAR"]'), ' ') WHEN comments LIKE '{{%' AND json_valid(comments) THEN coalesce(json_extract_string(comments, '$.body'), comments) ELSE comments END AS comments,
{', '.join(f"round(CASE WHEN {c} LIKE '[%' THEN cast({c} ->> 0 AS DOUBLE) + CASE WHEN cast({c} ->> 0 AS DOUBLE) < 0 THEN -1 ELSE 1 END * coalesce(try_cast({c} ->> 1 AS DOUBLE), 0) / 60 WHEN {c} LIKE '{{%' THEN try_cast({c} ->> 'deg' AS DOUBLE) ELSE try_cast(trim({c}) AS DOUBLE) END, 6) AS {c}" for c in ('latitude', 'longitude'))} FROM raw_rows r LEFT JOIN y USING (file_id, row_no)""",
}
