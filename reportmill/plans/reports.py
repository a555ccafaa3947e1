"""Queries of the report pipeline over whole tables, each beside the SQL that gives the same rows."""

from __future__ import annotations

from dataclasses import replace
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reportmill.functions import dates, text
from reportmill.operators import acquire, archetypes, clean, crossref, events, explore, flaps, geocode, samenight, signatures, vectors, vocab
from reportmill.params import DEFAULT
from reportmill.runtime import materialize, table
from reportmill.sources import html, writers
from reportmill.streaming import bursts

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: The tables hold about one report per state and week, so bursts are looked for at lower gates than the defaults.
LOW = replace(DEFAULT, flap_first_year=1950, flap_state_gate=5, flap_week_gate=2, flap_floor=0.0, flap_min_reports=2)
#: Vectors of one date are hardly related in the tables.
LOOSE_NIGHT = replace(DEFAULT, night_min_reports=2, night_distance=0.95, night_min_size=2)
PHRASES = ["next to that", "the night was", "blocked part of the view", "school yard", "my wife", "came from"]


def query(sql: str | None = None, dates: tuple[str, ...] = (), times: tuple[str, ...] = ()):
    """Registers a query under its function's name, with its SQL if there is one.

    ``dates`` and ``times``: columns that leave as text, in the same form from both engines.
    """

    def register(f):
        @wraps(f)
        def as_text(spark: SparkSession, folder: str) -> DataFrame:
            return f(spark, folder).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates} | {c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in times})

        QUERIES[f.__name__] = as_text
        as_text.__wrapped__ = f
        if sql:
            forms = [f"strftime(\"{c}\", '%Y-%m-%d') AS \"{c}\"" for c in dates] + [f"strftime(\"{c}\", '%Y-%m-%d %H:%M:%S') AS \"{c}\"" for c in times]
            SQL[f.__name__] = f"SELECT * REPLACE ({', '.join(forms)}) FROM ({sql})" if forms else sql
        return as_text

    return register


def reports(spark: SparkSession, folder: str) -> DataFrame:
    """The cleaned reports with states in one case and nothing null among the grouped texts."""
    t = table(spark, folder, "nuforc_clean")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return t.select("source_id", "event_dt", "event_date", "event_year", "event_decade", blank("city"), F.upper(F.trim(blank("state"))).alias("state"), blank("shape_norm"), blank("narrative"), "narrative_chars", "latitude", "longitude", "geocode_method")


R = """reports AS (SELECT source_id, event_dt, event_date, event_year, event_decade, coalesce(city, '') AS city, upper(trim(coalesce(state, ''))) AS state,
  coalesce(shape_norm, '') AS shape_norm, coalesce(narrative, '') AS narrative, narrative_chars, latitude, longitude, geocode_method FROM nuforc_clean)"""


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(_quoted(x) if isinstance(x, str) else "NULL" if x is None else str(x) for x in r) + ")" for r in rows) + ")"


# --- vocabulary ---

_RATES = f"""{R}, v(term, pattern) AS {_values(list(vocab.VOCABULARY.items()))},
n AS (SELECT cast(event_year // 5 * 5 AS INT) AS time_bin, lower(narrative) AS t FROM reports WHERE event_year >= 1940),
h AS (SELECT time_bin, term, cast(sum(cast(regexp_matches(t, pattern) AS INT)) AS BIGINT) AS hits, count(*) AS narratives FROM n CROSS JOIN v GROUP BY ALL),
rates AS (SELECT time_bin, term, hits, narratives, round(hits * 1000 / narratives, 4) AS rate_per_1k FROM h QUALIFY sum(hits) OVER (PARTITION BY term) > 0)"""
_MERGED = f"""{_RATES}, merged AS (SELECT time_bin, CASE WHEN term IN ('tic-tac', 'tic tac') THEN 'tic-tac' WHEN term IN ('triangle', 'triangular') THEN 'triangle/triangular' ELSE term END AS term,
round(sum(rate_per_1k), 4) AS rate_per_1k FROM rates GROUP BY ALL)"""


@query(f"WITH {_RATES} SELECT * FROM rates")
def vocab_rate(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.rates(reports(spark, folder))


@query(f"WITH {_MERGED} SELECT * FROM merged")
def vocab_merged(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.merged(vocab_rate(spark, folder))


@query(f"""WITH {_MERGED} SELECT term, arg_max(time_bin, rate_per_1k * 100000 - time_bin / 100000) AS peak_bin, round(max(rate_per_1k), 2) AS peak_rate_per_1k,
cast(floor(sum(rate_per_1k) + 1e-9) AS BIGINT) AS total_mentions FROM merged GROUP BY term""")
def vocab_peaks(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.peaks(vocab_merged(spark, folder))


@query(f"""WITH {_MERGED} SELECT term, time_bin, CASE WHEN m > 0 THEN round(rate_per_1k / m + 1e-9, 4) ELSE 0 END AS share_of_peak
FROM (SELECT *, max(rate_per_1k) OVER (PARTITION BY term) AS m, sum(rate_per_1k) OVER (PARTITION BY term) AS s FROM merged) WHERE s >= 1""")
def vocab_heatmap_norm(spark: SparkSession, folder: str) -> DataFrame:
    return vocab.heatmap(vocab_merged(spark, folder))


# --- explorer ---


@query(f"WITH {R} SELECT event_year, count(*) AS n_reports FROM reports WHERE event_year IS NOT NULL GROUP BY 1")
def year_counts(spark: SparkSession, folder: str) -> DataFrame:
    return explore.counts(reports(spark, folder), "event_year")


@query(f"WITH {R} SELECT event_decade, count(*) AS n_reports FROM reports WHERE event_decade IS NOT NULL GROUP BY 1")
def decade_counts(spark: SparkSession, folder: str) -> DataFrame:
    return explore.counts(reports(spark, folder), "event_decade")


@query(f"""WITH {R} SELECT count(*) AS n_reports, count(DISTINCT nullif(state, '')) AS n_states, min(event_year) AS first_year, max(event_year) AS last_year,
count(DISTINCT nullif(shape_norm, '')) AS n_shapes, cast(median(narrative_chars) AS DOUBLE) AS median_chars FROM reports""")
def overview_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return explore.metrics(reports(spark, folder))


def _top(key: str, n: int) -> str:
    return f"""WITH {R}, c AS (SELECT {key}, count(*) AS n_reports FROM reports WHERE {key} <> '' GROUP BY 1)
SELECT {key}, n_reports, round(n_reports * 100 / (SELECT sum(n_reports) FROM c), 1) AS pct FROM c ORDER BY n_reports DESC, {key} LIMIT {n}"""


@query(_top("shape_norm", 15))
def top_shapes(spark: SparkSession, folder: str) -> DataFrame:
    return explore.top(reports(spark, folder), "shape_norm", 15)


@query(_top("state", 20))
def top_states(spark: SparkSession, folder: str) -> DataFrame:
    return explore.top(reports(spark, folder), "state", 20)


@query(f"WITH {R} SELECT state, count(*) AS n_reports, row_number() OVER (ORDER BY count(*) DESC, state) AS rank FROM reports WHERE state <> '' GROUP BY 1")
def state_rank(spark: SparkSession, folder: str) -> DataFrame:
    return explore.ranked(reports(spark, folder), "state")


@query(f"""WITH {R} SELECT source_id, event_year, state, shape_norm, city FROM reports
WHERE event_year BETWEEN 1990 AND 2015 AND state IN ('WA', 'CA', 'TX', 'OR') AND shape_norm IN ('light', 'triangle', 'circle', 'sphere') AND contains(lower(narrative), 'the')""")
def explorer_filter(spark: SparkSession, folder: str) -> DataFrame:
    got = explore.filtered(reports(spark, folder), 1990, 2015, ["WA", "CA", "TX", "OR"], ["light", "triangle", "circle", "sphere"], "THE")
    return got.select("source_id", "event_year", "state", "shape_norm", "city")


@query(f"""WITH {R} SELECT source_id, city, shape_norm FROM reports WHERE contains(lower(city), 'lake') OR contains(lower(shape_norm), 'lake') OR contains(lower(narrative), 'lake')""")
def text_search(spark: SparkSession, folder: str) -> DataFrame:
    return explore.searched(reports(spark, folder), "Lake", ["city", "shape_norm", "narrative"]).select("source_id", "city", "shape_norm")


@query(f"""WITH {R}, w AS (SELECT state, count(*) AS n FROM reports WHERE state <> '' GROUP BY 1), p AS (SELECT upper(trim(usps)) AS state, count(*) AS weight FROM gazetteer GROUP BY 1),
j AS (SELECT w.state, n, weight FROM w JOIN p USING (state)) SELECT state, n AS n_reports, round((n / sum(n) OVER ()) / (weight / sum(weight) OVER ()), 4) AS anomaly FROM j""")
def state_anomaly(spark: SparkSession, folder: str) -> DataFrame:
    weight = table(spark, folder, "gazetteer").groupBy(F.upper(F.trim("usps")).alias("state")).agg(F.count("*").alias("weight"))
    return explore.anomaly(reports(spark, folder), weight)


@query(f"""WITH {R} SELECT 'reports' AS collection, count(*) AS n_matches FROM reports WHERE contains(lower(narrative), 'moor') OR contains(lower(city), 'moor')
UNION ALL SELECT 'places', count(*) FROM gazetteer WHERE contains(lower(name), 'moor') UNION ALL SELECT 'documents', count(*) FROM documents WHERE contains(lower(text), 'moor')
UNION ALL SELECT 'states', count(*) FROM state_centroid WHERE contains(lower(state_name), 'moor')""")
def router_counts(spark: SparkSession, folder: str) -> DataFrame:
    t = lambda n: table(spark, folder, n)
    frames = {"reports": (reports(spark, folder), ["narrative", "city"]), "places": (t("gazetteer"), ["name"]), "documents": (t("documents"), ["text"]), "states": (t("state_centroid"), ["state_name"])}
    return explore.matches(frames, "Moor")


@query(r"""SELECT r.file_id, r.row_no, replace(regexp_replace(t.fullkey, '^\$\.?', ''), '"', '') AS path,
CASE WHEN t.type IN ('DOUBLE', 'FLOAT') THEN regexp_replace(cast(t.atom AS VARCHAR), '\.0$', '') WHEN t.type = 'VARCHAR' THEN json_extract_string(t.atom, '$') WHEN t.type = 'NULL' THEN 'null' ELSE cast(t.atom AS VARCHAR) END AS value
FROM raw_rows r, json_tree(r.payload) t WHERE json_valid(r.payload) AND t.type NOT IN ('OBJECT', 'ARRAY')""")
def json_flatten(spark: SparkSession, folder: str) -> DataFrame:
    """Payloads with lists and objects in them, leaf by leaf."""
    return explore.flattened(table(spark, folder, "raw_rows"), ["file_id", "row_no"], "payload")


@query(f"WITH {_MERGED} SELECT term, min(time_bin) FILTER (rate_per_1k > 0) AS first_bin, arg_max(time_bin, rate_per_1k * 100000 - time_bin / 100000) AS peak_bin, min(rate_per_1k) AS lowest, max(rate_per_1k) AS highest FROM merged GROUP BY 1")
def vocab_first_and_peak(spark: SparkSession, folder: str) -> DataFrame:
    return explore.first_and_peak(vocab_merged(spark, folder))


@query(f"""WITH {R}, e(era, a, b) AS {_values(list(explore.ERAS))}, y AS (SELECT event_year, count(*) AS n FROM reports WHERE event_year IS NOT NULL GROUP BY 1),
m AS (SELECT event_year, n, (SELECT arg_min(era, a) FROM e WHERE event_year BETWEEN a AND b) AS era FROM y) SELECT era, cast(sum(n) AS BIGINT) AS n_reports FROM m GROUP BY 1""")
def era_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).where("event_year IS NOT NULL").groupBy(explore.era(F.col("event_year")).alias("era")).agg(F.count("*").alias("n_reports"))


@query(r"""SELECT * FROM (SELECT row_id, try_cast(regexp_extract(duration_hours, '^\s*([+-]?\d+)', 1) AS INT) AS number FROM nuforc) WHERE number IS NOT NULL""")
def leading_numbers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nuforc").select("row_id", explore.leading_number(F.col("duration_hours")).alias("number")).where("number IS NOT NULL")


@query(f"WITH {R}, c AS (SELECT state, count(*) AS n_reports FROM reports WHERE state <> '' GROUP BY 1) SELECT state, n_reports, round(least(n_reports / max(n_reports) OVER (), 1), 4) AS scaled FROM c")
def state_bubbles(spark: SparkSession, folder: str) -> DataFrame:
    return explore.scaled(explore.counts(reports(spark, folder).where("state <> ''"), "state"), "n_reports")


@query(f"WITH {R} SELECT source_id, event_year, state FROM reports ORDER BY md5(source_id || ':42'), source_id LIMIT 100")
def sample_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A seeded sample of exact size, the feature itself."""
    return explore.sampled(reports(spark, folder), 100).select("source_id", "event_year", "state")


# --- acquisition and cleaning ---

_PARSED = r"""p AS (SELECT *, regexp_replace(trim(datetime), '\s+(Local|Pacific|Eastern|Central|Mountain|UTC)$', '') AS s FROM nuforc),
q AS (SELECT *, regexp_extract(s, '^(\d{1,2})/(\d{1,2})/(\d{4}|\d{2})\s+(\d{1,2}):(\d{2})$', ['m', 'd', 'y', 'h', 'n']) AS g FROM p),
t AS (SELECT *, CASE WHEN g.m <> '' THEN try_cast(printf('%04d-%02d-%02d %02d:%02d:00', CASE WHEN length(g.y) = 2 THEN try_cast(g.y AS INT) + CASE WHEN try_cast(g.y AS INT) <= 29 THEN 2000 ELSE 1900 END ELSE try_cast(g.y AS INT) END,
  try_cast(g.m AS INT), try_cast(g.d AS INT), try_cast(g.h AS INT) % 24, try_cast(g.n AS INT)) AS TIMESTAMP) WHEN regexp_matches(s, '^\d{4}-\d{2}-\d{2}( \d{2}:\d{2}(:\d{2})?)?$') THEN try_cast(s AS TIMESTAMP) END AS event_dt FROM q)"""
_STRIP = "x"
for _note in text.EDITOR_NOTES:
    _STRIP = f"regexp_replace({_STRIP}, {_quoted(_note)}, '', 'gi')"
_JUDGED = rf"""{_PARSED}, u AS (SELECT *, replace(replace(replace(coalesce(comments, ''), '&#44;', ','), '&#44', ','), '&apos;', '''') AS x0 FROM t),
b AS (SELECT *, replace(trim(regexp_replace(regexp_replace(x0, '\r\n|\r|\n+', ' || ', 'g'), '\s+', ' ', 'g')), ' || ', chr(10) || chr(10)) AS x FROM u),
c AS (SELECT *, regexp_replace(regexp_replace({_STRIP}, '\s+PD\.?\s*$', ''), '^\s+|\s+$', '', 'g') AS text0, upper(trim(coalesce(state, ''))) AS st, lower(trim(coalesce(country, ''))) AS co FROM b),
e AS (SELECT *, CASE WHEN event_dt IS NULL THEN 'unparseable_datetime' WHEN length(text0) < 30 THEN 'narrative_too_short' WHEN NOT (co = 'us' OR st IN ({", ".join(map(_quoted, text.STATE_CODES))})) THEN 'non_us' END AS early FROM c),
f AS (SELECT *, (SELECT bool_or(latitude IS NOT NULL) FROM e WHERE early IS NULL) AS located FROM e),
judged AS (SELECT *, coalesce(early, CASE WHEN located AND NOT coalesce(latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180, false) THEN 'invalid_coordinates'
  WHEN NOT year(event_dt) BETWEEN 1900 AND 2026 THEN 'year_out_of_range' END) AS reason FROM f)"""


@query(f"WITH {_PARSED} SELECT row_id, event_dt FROM t", times=("event_dt",))
def parse_datetime_cases(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nuforc").select("row_id", dates.parse_event(F.col("datetime")).alias("event_dt"))


@query("""SELECT s AS shape_norm, count(*) AS n_rows FROM (SELECT CASE x WHEN 'changed' THEN 'changing' WHEN 'round' THEN 'sphere' WHEN 'disk' THEN 'disc' ELSE x END AS s
FROM (SELECT lower(trim(coalesce(shape, ''))) AS x FROM nuforc)) GROUP BY 1""")
def shape_norm(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nuforc").groupBy(text.clean_shape(F.col("shape")).alias("shape_norm")).agg(F.count("*").alias("n_rows"))


@query("""SELECT row_id, substr(sha1(coalesce(datetime, 'nan') || '|' || coalesce(city, 'nan') || '|' || coalesce(state, 'nan') || '|' || substr(coalesce(comments, 'nan'), 1, 200)), 1, 16) AS own_id FROM nuforc""")
def source_id(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nuforc").select("row_id", acquire.source_id().alias("own_id"))


@query(f"WITH {_JUDGED} SELECT source_id, row_id, event_dt, st AS state, co AS country, text0 AS narrative, length(text0) AS narrative_chars FROM judged WHERE reason IS NULL", times=("event_dt",))
def clean_rows(spark: SparkSession, folder: str) -> DataFrame:
    return clean.judged(table(spark, folder, "nuforc")).where("reason IS NULL").select("source_id", "row_id", "event_dt", "state", "country", "narrative", "narrative_chars")


@query(f"WITH {_JUDGED} SELECT source_id, reason FROM judged WHERE reason IS NOT NULL")
def clean_drop_log(spark: SparkSession, folder: str) -> DataFrame:
    return clean.drops(table(spark, folder, "nuforc"))


@query(f"WITH {_JUDGED} SELECT reason, count(*) AS n_rows, round(count(*) * 100 / (SELECT count(*) FROM nuforc), 2) AS pct FROM judged WHERE reason IS NOT NULL GROUP BY 1")
def clean_report(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "nuforc")
    return writers.drop_report(raw, clean.drops(raw))


@query("""SELECT source_id, row_id FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY acquired_at DESC, row_id DESC) AS rn FROM nuforc) WHERE rn = 1""")
def latest_acquisition(spark: SparkSession, folder: str) -> DataFrame:
    raw = table(spark, folder, "nuforc").select("source_id", "row_id", "acquired_at")
    return raw.groupBy("source_id").agg(F.max(F.struct("acquired_at", "row_id")).alias("m")).select("source_id", "m.row_id")


@query("""WITH a AS (SELECT row_id, string_split(coalesce(city, '') || ', ' || coalesce(state, '') || ', ' || coalesce(country, ''), ',') AS p FROM nuforc)
SELECT row_id, trim(p[1]) AS p_city, coalesce(trim(p[2]), '') AS p_state, coalesce(trim(p[3]), '') AS p_country FROM a""")
def location_parts(spark: SparkSession, folder: str) -> DataFrame:
    whole = F.concat_ws(", ", *[F.coalesce(F.col(c), F.lit("")) for c in ("city", "state", "country")])
    city, state, country = acquire.location_parts(whole)
    return table(spark, folder, "nuforc").select("row_id", city.alias("p_city"), state.alias("p_state"), country.alias("p_country"))


# --- places ---

_GAZ = r"""gaz AS (SELECT name, state, lat, lon FROM (SELECT *, row_number() OVER (PARTITION BY name, state ORDER BY place_id) AS rn FROM (SELECT place_id, trim(usps) AS state,
  trim(regexp_replace(lower(name), '\s+(city|town|cdp|village|borough|township|plantation|municipality|charter township|metro township)$', '')) AS name, try_cast(trim(intptlat) AS DOUBLE) AS lat, try_cast(trim(intptlong) AS DOUBLE) AS lon FROM gazetteer)
  WHERE name IS NOT NULL AND state IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL) WHERE rn = 1)"""
_LOCATED = rf"""{R}, {_GAZ}, n0 AS (SELECT source_id, city, state, trim(regexp_replace(lower(trim(city)), '\s*\([^)]*\)\s*', ' ', 'g')) AS c FROM reports),
n1 AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(c, '^(north|south|east|west|n\.|s\.|e\.|w\.)\s+', ''), '^st\.?\s+', 'saint '), ',\s*[a-z]{{2}}$', '')) AS v0 FROM n0),
n2 AS (SELECT *, trim(regexp_replace(v0, '^(north|south|east|west|new|old|upper|lower|mount|mt\.?|fort|ft\.?)\s+', '')) AS v1, trim(regexp_replace(v0, '\s+(heights|hills|beach|springs|park|lake|landing|junction|center|centre)$', '')) AS v2 FROM n1),
located AS (SELECT n2.source_id, n2.city, n2.state, coalesce(a.lat, b.lat, d.lat, s.lat) AS latitude, coalesce(a.lon, b.lon, d.lon, s.lon) AS longitude,
  CASE WHEN a.lat IS NOT NULL THEN 'exact' WHEN b.lat IS NOT NULL OR d.lat IS NOT NULL THEN 'fuzzy' WHEN s.lat IS NOT NULL THEN 'state_centroid' END AS geocode_method
  FROM n2 LEFT JOIN gaz a ON a.name = v0 AND a.state = n2.state LEFT JOIN gaz b ON b.name = v1 AND b.state = n2.state LEFT JOIN gaz d ON d.name = v2 AND d.state = n2.state LEFT JOIN state_centroid s ON s.state = n2.state)"""


@query(f"WITH {_GAZ} SELECT * FROM gaz")
def dedupe_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return geocode.gazetteer(table(spark, folder, "gazetteer"))


def _located(spark: SparkSession, folder: str) -> DataFrame:
    return geocode.geocoded(reports(spark, folder).select("source_id", "city", "state"), geocode.gazetteer(table(spark, folder, "gazetteer")), table(spark, folder, "state_centroid"))


@query(f"WITH {_LOCATED} SELECT * FROM located")
def geocode_three_pass(spark: SparkSession, folder: str) -> DataFrame:
    return _located(spark, folder)


@query(f"""WITH {_LOCATED} SELECT city, state, count(*) AS n_reports FROM located WHERE geocode_method IS NULL OR geocode_method = 'state_centroid' GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 20""")
def geocode_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return geocode.unmatched(_located(spark, folder))


# --- flaps ---

def _flap(p) -> str:
    return f"""{R}, r AS (SELECT source_id, state, event_date AS d, city, shape_norm FROM reports WHERE state <> '' AND event_date IS NOT NULL AND year(event_date) >= {p.flap_first_year}),
base AS (SELECT state, year(d) AS year, count(*) AS annual, count(*) / 52 AS baseline_weekly FROM r GROUP BY 1, 2),
w AS (SELECT state, cast(date_trunc('week', d) AS DATE) AS week_start, cast(date_trunc('week', d) AS DATE) + 6 AS week_end, count(*) AS reports FROM r GROUP BY 1, 2, 3),
b AS (SELECT w.state, week_start, week_end, reports, round(baseline_weekly, 2) AS baseline_weekly, round(reports / baseline_weekly, 1) AS ratio FROM w JOIN base ON base.state = w.state AND base.year = year(week_end)
  WHERE reports >= {p.flap_week_gate} AND baseline_weekly >= {p.flap_floor} AND reports / baseline_weekly >= {p.flap_ratio} AND w.state IN (SELECT state FROM r GROUP BY 1 HAVING count(*) >= {p.flap_state_gate})),
g AS (SELECT *, CASE WHEN week_start <= max(week_end) OVER (PARTITION BY state ORDER BY week_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {p.flap_gap_days} THEN 0 ELSE 1 END AS fresh FROM b),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY state ORDER BY week_start) AS island FROM g),
f AS (SELECT state, min(week_start) AS "start", max(week_end) AS "end", cast(sum(reports) AS BIGINT) AS flagged_reports, max(ratio) AS peak_ratio, arg_min(baseline_weekly, week_start) AS baseline_weekly FROM i GROUP BY state, island HAVING sum(reports) >= {p.flap_min_reports})"""


_FLAP = _flap(LOW)
_INSIDE = f"""{_FLAP}, x AS (SELECT f.state, f."start", r.* EXCLUDE (state) FROM f JOIN r ON r.state = f.state AND r.d BETWEEN f."start" AND f."end"),
dd AS (SELECT state, "start", d, count(*) AS n FROM x GROUP BY 1, 2, 3),
pk AS (SELECT state, "start", arg_max(d, n * 100000000 - (d - DATE '1900-01-01')) AS pd, max(n) AS pn, min(d) AS first, count(*) AS days FROM dd GROUP BY 1, 2),
hl AS (SELECT pk.state, pk."start", CASE WHEN days >= 3 THEN pd ELSE first END AS peak_date, CASE WHEN days >= 3 THEN (SELECT min(dd.d) FROM dd WHERE dd.state = pk.state AND dd."start" = pk."start" AND dd.d > pd AND dd.n <= pn / 2) - pd END AS half_life_days FROM pk),
sh AS (SELECT state, "start", string_agg(shape_norm, ', ' ORDER BY rn) AS top_3_shapes FROM (SELECT state, "start", shape_norm, row_number() OVER (PARTITION BY state, "start" ORDER BY count(*) DESC, shape_norm) AS rn FROM x WHERE shape_norm <> '' GROUP BY 1, 2, 3) WHERE rn <= 3 GROUP BY 1, 2),
en AS (SELECT f.state, f."start", f."end", peak_date, n_reports, f."end" - f."start" + 1 AS duration_days, peak_ratio, baseline_weekly, n_cities, string_split(top_3_shapes, ', ')[1] AS top_shape, top_3_shapes, half_life_days
  FROM f JOIN (SELECT state, "start", count(*) AS n_reports, count(DISTINCT city) AS n_cities FROM x GROUP BY 1, 2) c USING (state, "start") LEFT JOIN sh USING (state, "start") LEFT JOIN hl USING (state, "start")),
cc AS (SELECT a.state, a."start", coalesce(list_sort(list(DISTINCT b.state) FILTER (b.state IS NOT NULL)), []) AS s FROM f a LEFT JOIN f b ON a."start" <= b."end" AND b."start" <= a."end" AND NOT (a.state = b.state AND a."start" = b."start") GROUP BY 1, 2)"""


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.eligible(reports(spark, folder), LOW)


def _islands(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.islands(flaps.bursts(_rows(spark, folder), LOW), LOW)


@query(f"""WITH {_FLAP}, s AS (SELECT state, unnest(generate_series(min(week_start), max(week_start), INTERVAL 7 DAY))::DATE AS week_start FROM w GROUP BY 1)
SELECT state, s.week_start, s.week_start + 6 AS week_end, coalesce(w.reports, 0) AS reports FROM s LEFT JOIN w USING (state, week_start)""", dates=("week_start", "week_end"))
def weekly_counts_zero_filled(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.weekly_filled(_rows(spark, folder))


@query(f"WITH {_FLAP} SELECT state, cast(year AS INT) AS year, annual, round(baseline_weekly, 4) AS baseline_weekly FROM base")
def state_year_baseline(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.baselines(_rows(spark, folder), LOW).withColumn("baseline_weekly", F.round("baseline_weekly", 4))


@query(f"WITH {_FLAP} SELECT * FROM b", dates=("week_start", "week_end"))
def burst_weeks(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.bursts(_rows(spark, folder), LOW)


@query(f"WITH {_FLAP} SELECT * FROM f", dates=("start", "end"))
def flap_islands(spark: SparkSession, folder: str) -> DataFrame:
    return _islands(spark, folder)


@query(f"WITH {_INSIDE} SELECT state, \"start\", peak_date, half_life_days FROM hl", dates=("start", "peak_date"))
def flap_half_life(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.half_life(_rows(spark, folder), _islands(spark, folder))


@query(f"WITH {_INSIDE} SELECT * FROM en", dates=("start", "end", "peak_date"))
def flap_enriched(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.enriched(_rows(spark, folder), _islands(spark, folder))


@query(f"WITH {_INSIDE} SELECT state, \"start\", array_to_string(s, ',') AS concurrent, len(s) AS n_concurrent_states FROM cc", dates=("start",))
def flap_concurrent(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.concurrent(_islands(spark, folder)).select("state", "start", F.array_join("concurrent_states", ",").alias("concurrent"), "n_concurrent_states")


@query(f"""WITH {_INSIDE} SELECT * FROM (SELECT en.*, len(s) AS n_concurrent_states, row_number() OVER (ORDER BY n_reports DESC, state, "start") - 1 AS flap_id FROM en JOIN cc USING (state, "start")) WHERE flap_id < 100""", dates=("start", "end", "peak_date"))
def flap_catalog_top(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.catalog(_rows(spark, folder), LOW).drop("concurrent_states").orderBy("flap_id").limit(100)


@query(f"""WITH {_INSIDE}, s AS (SELECT state, "start", unnest(generate_series("start" - 14, "end" + 14, INTERVAL 1 DAY))::DATE AS day FROM f)
SELECT s.state, s."start", s.day, count(r.source_id) AS reports FROM s LEFT JOIN r ON r.state = s.state AND r.d = s.day GROUP BY 1, 2, 3""", dates=("start", "day"))
def flap_daily(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.daily_filled(_rows(spark, folder), _islands(spark, folder))


@query(f"WITH {_FLAP}, t(threshold) AS (VALUES (3.0), (10.0), (20.0), (40.0)) SELECT cast(threshold AS DOUBLE) AS threshold, count(*) AS n_weeks FROM b JOIN t ON ratio >= threshold GROUP BY 1")
def threshold_grid(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.threshold_grid(_rows(spark, folder), [3.0, 10.0, 20.0, 40.0], LOW)


@query(f"""WITH {_INSIDE}, t AS (SELECT year(peak_date) AS event_year, count(*) AS n FROM en GROUP BY 1) SELECT r.event_year, r.n_reports, coalesce(t.n, 0) AS n_marks
FROM (SELECT event_year, count(*) AS n_reports FROM reports WHERE event_year IS NOT NULL GROUP BY 1) r LEFT JOIN t USING (event_year)""")
def year_marks(spark: SparkSession, folder: str) -> DataFrame:
    marks = flap_enriched.__wrapped__(spark, folder).select(F.year("peak_date").alias("event_year"))
    return explore.yearly(reports(spark, folder), marks)


# --- events and cross-reference ---

_EVENTS = "ev AS (SELECT event, cast(a AS DATE) AS e0, cast(b AS DATE) AS e1, CASE WHEN st = '' THEN NULL ELSE string_split(st, ' ') END AS states, expected, kind FROM " + _values([(e[0], e[1], e[2], " ".join(e[3] or []), e[4], e[6]) for e in events.CATALOG]) + " t(event, a, b, st, expected, kind))"
_COVER = f"""{_EVENTS}, em AS (SELECT event, source_id, state, shape_norm FROM reports JOIN ev ON event_date BETWEEN e0 AND e1 AND (states IS NULL OR list_contains(states, state))),
ts AS (SELECT event, arg_min(shape_norm, rn) AS top_shape FROM (SELECT event, shape_norm, row_number() OVER (PARTITION BY event ORDER BY count(*) DESC, shape_norm) AS rn FROM em WHERE shape_norm <> '' GROUP BY 1, 2) GROUP BY 1),
cov AS (SELECT ev.event, coalesce(n, 0) AS corpus_reports, top_shape, coalesce(top_shape = expected, false) AS shape_matches FROM ev LEFT JOIN (SELECT event, count(*) AS n FROM em GROUP BY 1) c USING (event) LEFT JOIN ts USING (event))"""


@query(f"WITH {R}, {_COVER} SELECT * FROM cov")
def event_coverage(spark: SparkSession, folder: str) -> DataFrame:
    return events.coverage(reports(spark, folder), events.catalog(spark))


_FLAP_MET = f"""{_INSIDE}, {_COVER}, fm AS (SELECT event, count(*) AS flap_count, max(n_reports) AS flap_max_reports, max(peak_ratio) AS flap_peak_ratio FROM en JOIN ev ON "start" <= e1 AND e0 <= "end" AND (states IS NULL OR list_contains(states, state)) GROUP BY 1)"""


@query(f"WITH {_FLAP_MET} SELECT ev.event, coalesce(flap_count, 0) AS flap_count, coalesce(flap_max_reports, 0) AS flap_max_reports, coalesce(flap_peak_ratio, 0) AS flap_peak_ratio FROM ev LEFT JOIN fm USING (event)")
def event_flap_match(spark: SparkSession, folder: str) -> DataFrame:
    rows = _rows(spark, folder)
    return events.flaps_met(flaps.enriched(rows, _islands(spark, folder)), events.catalog(spark))


@query()
def event_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Rests on the clusters of one night, which SQL has no form for."""
    rep, cat = reports(spark, folder), events.catalog(spark)
    night = samenight.members(rep, table(spark, folder, "nuforc_embeddings"), LOOSE_NIGHT)
    found = materialize(signatures.signatures(rep, events.members(rep, cat), "event"), "signatures")
    islands = materialize(_islands(spark, folder), "flaps")
    return events.matrix(rep, cat, night, flaps.enriched(_rows(spark, folder), islands), found)


@query()
def event_detections(spark: SparkSession, folder: str) -> DataFrame:
    return explore.detections(event_matrix(spark, folder))


def records(spark: SparkSession, folder: str) -> DataFrame:
    """A second dated and located dataset: urgent orders, in the state their customer number falls on."""
    states = table(spark, folder, "state_centroid").select("state", (F.row_number().over(Window.orderBy("state")) - 1).alias("k"))
    urgent = table(spark, folder, "orders").where("o_orderpriority = '1-URGENT'")
    return urgent.select(F.col("o_orderkey").alias("record_id"), F.to_date("o_orderdate").alias("incident_date"), F.pmod("o_custkey", F.lit(51)).alias("k")).join(F.broadcast(states), "k").drop("k")


_REC = "rec AS (SELECT o_orderkey AS record_id, cast(o_orderdate AS DATE) AS incident_date, s.state FROM orders JOIN (SELECT state, row_number() OVER (ORDER BY state) - 1 AS k FROM state_centroid) s ON k = o_custkey % 51 WHERE o_orderpriority = '1-URGENT')"


@query(f"""WITH {R}, {_REC} SELECT record_id, rec.state, incident_date, count(*) AS n_reports, min(event_date) AS first_day, max(event_date) AS last_day,
coalesce(array_to_string(list_slice(list_sort(list(DISTINCT nullif(shape_norm, '')) FILTER (shape_norm <> '')), 1, 5), ', '), '') AS shapes
FROM rec JOIN reports ON reports.state = rec.state AND event_date BETWEEN incident_date - 7 AND incident_date + 7 GROUP BY 1, 2, 3""", dates=("incident_date", "first_day", "last_day"))
def xref_state_window(spark: SparkSession, folder: str) -> DataFrame:
    return crossref.same_state(records(spark, folder), reports(spark, folder))


@query(f"""WITH {R}, {_REC} SELECT record_id, incident_date, count(*) AS n_reports, count(DISTINCT nullif(reports.state, '')) AS n_states FROM rec JOIN reports ON event_date BETWEEN incident_date - 1 AND incident_date + 1 GROUP BY 1, 2 HAVING count(*) >= 3""", dates=("incident_date",))
def xref_date_only(spark: SparkSession, folder: str) -> DataFrame:
    return crossref.any_state(records(spark, folder), reports(spark, folder))


# --- phrases ---


@query(f"WITH {R}, p(phrase) AS {_values([(p,) for p in PHRASES])} SELECT phrase, count(*) FILTER (contains(lower(narrative), phrase)) AS docs, round(count(*) FILTER (contains(lower(narrative), phrase)) * 100 / count(*), 4) AS rate_pct FROM reports CROSS JOIN p GROUP BY 1")
def phrase_doc_rate(spark: SparkSession, folder: str) -> DataFrame:
    return signatures.phrase_rates(reports(spark, folder), PHRASES)


_LABELS = "lab AS (SELECT source_id, min(archetype) AS archetype FROM archetypes WHERE archetype >= 0 GROUP BY 1)"


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "archetypes").where("archetype >= 0").groupBy("source_id").agg(F.min("archetype").alias("archetype"))


@query(f"""WITH {R}, {_LABELS}, p(phrase) AS {_values([(p,) for p in PHRASES])}, a AS (SELECT phrase, count(*) FILTER (contains(lower(narrative), phrase)) AS t, count(*) AS n0 FROM reports CROSS JOIN p GROUP BY 1),
o AS (SELECT archetype, phrase, count(*) FILTER (contains(lower(narrative), phrase)) AS own, count(*) AS n FROM reports JOIN lab USING (source_id) CROSS JOIN p GROUP BY 1, 2)
SELECT archetype, phrase, round((own / n) / (t / n0), 4) AS lift FROM o JOIN a USING (phrase) WHERE t > 0""")
def phrase_lift(spark: SparkSession, folder: str) -> DataFrame:
    return signatures.lift(reports(spark, folder), _labels(spark, folder), "archetype", PHRASES)


def _gram_sql(low: int, high: int) -> str:
    stop = ", ".join(map(_quoted, signatures.STOP_WORDS))
    parts = " UNION ALL ".join(f"SELECT source_id, unnest(list_transform(generate_series(1, len(w) - {n - 1}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' '))) AS term FROM tok WHERE len(w) >= {n}" for n in range(low, high + 1))
    return rf"tok AS (SELECT source_id, list_filter(regexp_extract_all(lower(narrative), '\b[a-z][a-z]+\b'), lambda x: NOT x IN ({stop})) AS w FROM reports), occ AS ({parts})"


def _sig(group: str, n: int = 20) -> str:
    """Signatures of the groups in ``known`` (group, source_id)."""
    return f"""{_gram_sql(2, 3)}, voc AS (SELECT term, count(*) AS total FROM occ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8000),
kn AS (SELECT DISTINCT {group}, source_id FROM known SEMI JOIN reports USING (source_id)), sz AS (SELECT {group}, count(*) AS n_reports FROM kn GROUP BY 1 HAVING count(*) >= 3),
ct AS (SELECT {group}, term, count(*) AS e, count(DISTINCT source_id) AS docs, any_value(total) AS total FROM occ JOIN kn USING (source_id) JOIN sz USING ({group}) JOIN voc USING (term) GROUP BY 1, 2),
bg AS (SELECT {group}, voc.term, voc.total - coalesce(e, 0) AS b, e, docs, CASE WHEN e IS NOT NULL AND voc.total > e THEN 1 ELSE ln(1.5) + 1 END AS idf FROM sz CROSS JOIN voc LEFT JOIN ct USING ({group}, term)),
wt AS (SELECT *, CASE WHEN e > 0 THEN (1 + ln(e)) * idf ELSE 0 END AS we, CASE WHEN b > 0 THEN (1 + ln(CASE WHEN b > 0 THEN b END)) * idf ELSE 0 END AS wb FROM bg),
sc AS (SELECT {group}, term, docs, we / sqrt(sum(we * we) OVER w) - wb / sqrt(sum(wb * wb) OVER w) AS score FROM wt WINDOW w AS (PARTITION BY {group})),
rk AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY round(score, 6) DESC, term) AS rn FROM sc WHERE score > 1e-9 AND docs IS NOT NULL),
sg AS (SELECT {group}, term AS phrase, round(score, 4) AS distinctiveness, docs AS group_count, round(docs * 100 / n_reports, 2) AS rate_pct, n_reports FROM rk JOIN sz USING ({group}) WHERE rn <= {n})"""


@query(f"WITH {R}, {_LABELS}, known AS (SELECT archetype, source_id FROM lab), {_sig('archetype')} SELECT * FROM sg")
def ngram_signature(spark: SparkSession, folder: str) -> DataFrame:
    return signatures.signatures(reports(spark, folder), _labels(spark, folder), "archetype")


@query(f"""WITH {R}, {_LABELS}, {_gram_sql(1, 2)}, tf AS (SELECT archetype, term, count(*) AS tf FROM occ JOIN lab USING (source_id) GROUP BY 1, 2),
st AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, term LIMIT 10000),
wt AS (SELECT archetype, term, tf * (ln((1 + (SELECT count(DISTINCT archetype) FROM tf)) / (1 + df)) + 1) AS w FROM tf JOIN st USING (term)),
sc AS (SELECT archetype, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY archetype)), 6) AS tfidf FROM wt),
rk AS (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY tfidf DESC, term) AS rank FROM sc) SELECT archetype, rank, term, round(tfidf, 4) AS tfidf FROM rk WHERE rank <= 10""")
def class_tfidf_top(spark: SparkSession, folder: str) -> DataFrame:
    return signatures.class_terms(reports(spark, folder), _labels(spark, folder), "archetype")


@query(f"WITH {R}, {_COVER}, known AS (SELECT event, source_id FROM em), {_sig('event')} SELECT * FROM sg")
def event_signature(spark: SparkSession, folder: str) -> DataFrame:
    """The same operator over the catalog's events."""
    rep = reports(spark, folder)
    return signatures.signatures(rep, events.members(rep, events.catalog(spark)), "event")


# --- vectors ---

_UNITS = """em AS (SELECT source_id, any_value(embedding) AS v FROM nuforc_embeddings WHERE source_id IS NOT NULL AND len(embedding) > 0 GROUP BY 1),
un AS (SELECT source_id, list_transform(v, lambda x: x::DOUBLE / n) AS u FROM (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM em) WHERE n > 0)"""


@query(f"WITH {_UNITS}, {_LABELS}, fl AS (SELECT archetype, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM un JOIN lab USING (source_id)), s AS (SELECT archetype, i, sum(x) AS s, count(*) AS n FROM fl GROUP BY 1, 2) SELECT archetype, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 1 END, 5) AS coherence FROM s GROUP BY 1")
def group_coherence(spark: SparkSession, folder: str) -> DataFrame:
    placed = _labels(spark, folder).join(vectors.units(table(spark, folder, "nuforc_embeddings")), "source_id")
    return vectors.coherence(placed, ["archetype"]).withColumn("coherence", F.round("coherence", 5))


@query(f"""WITH {_UNITS}, {_LABELS}, fl AS (SELECT archetype, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM un JOIN lab USING (source_id)), c AS (SELECT archetype, list(m ORDER BY i) AS c FROM (SELECT archetype, i, avg(x) AS m FROM fl GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT archetype, source_id, round(list_cosine_similarity(u, c), 6) AS similarity FROM un JOIN lab USING (source_id) JOIN c USING (archetype)) SELECT archetype, source_id AS medoid, round(similarity, 5) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY archetype ORDER BY similarity DESC, source_id) AS rn FROM s) WHERE rn = 1""")
def centroid_medoid(spark: SparkSession, folder: str) -> DataFrame:
    placed = _labels(spark, folder).join(vectors.units(table(spark, folder, "nuforc_embeddings")), "source_id")
    return vectors.medoids(placed, ["archetype"]).withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {R}, {_UNITS}, fl AS (SELECT event_date, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM reports JOIN un USING (source_id) WHERE event_date IS NOT NULL), s AS (SELECT event_date, i, sum(x) AS s, count(*) AS n FROM fl GROUP BY 1, 2)
SELECT event_date, max(n) AS n, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 1 END, 5) AS coherence FROM s GROUP BY 1""", dates=("event_date",))
def date_coherence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean cosine over all pairs of a date's reports, without forming pairs."""
    r = reports(spark, folder).select("source_id", "event_date").where("event_date IS NOT NULL").join(vectors.units(table(spark, folder, "nuforc_embeddings")), "source_id")
    return vectors.coherence(r, ["event_date"]).withColumn("coherence", F.round("coherence", 5))


@query(f"""WITH {_UNITS}, {_LABELS}, fl AS (SELECT archetype, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM un JOIN lab USING (source_id)), c AS (SELECT archetype, list(m ORDER BY i) AS c FROM (SELECT archetype, i, avg(x) AS m FROM fl GROUP BY 1, 2) GROUP BY 1)
SELECT archetype, source_id, round(list_cosine_similarity(u, c), 5) AS cosine FROM un JOIN lab USING (source_id) JOIN c USING (archetype)""")
def cosine_to_centroid(spark: SparkSession, folder: str) -> DataFrame:
    placed = _labels(spark, folder).join(vectors.units(table(spark, folder, "nuforc_embeddings")), "source_id")
    near = placed.join(vectors.centroids(placed, ["archetype"]), "archetype")
    return near.select("archetype", "source_id", F.round(vectors.cosine(F.col("unit"), F.col("centroid")), 5).alias("cosine"))


@query("SELECT count(*) AS n, round(avg(n), 4) AS mean_norm FROM (SELECT sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM nuforc_embeddings WHERE embedding IS NOT NULL)")
def norm_check(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "nuforc_embeddings").where("embedding IS NOT NULL").select(vectors.norm(F.col("embedding")).alias("n")).agg(F.count("*").alias("n"), F.round(F.avg("n"), 4).alias("mean_norm"))


@query("SELECT source_id FROM nuforc_clean c WHERE NOT EXISTS (SELECT 1 FROM nuforc_embeddings e WHERE e.source_id = c.source_id AND e.embedding IS NOT NULL)")
def embed_missing_anti(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "nuforc_embeddings").where("embedding IS NOT NULL").select("source_id")
    return table(spark, folder, "nuforc_clean").select("source_id").join(done, "source_id", "left_anti")


@query("""WITH o AS (SELECT DISTINCT source_id, 'vector' AS origin FROM nuforc_embeddings WHERE embedding IS NOT NULL), n AS (SELECT DISTINCT source_id, 'map' AS origin FROM archetypes)
SELECT * FROM o WHERE source_id NOT IN (SELECT source_id FROM n) UNION ALL SELECT * FROM n""")
def embed_upsert(spark: SparkSession, folder: str) -> DataFrame:
    old = table(spark, folder, "nuforc_embeddings").where("embedding IS NOT NULL").select("source_id", F.lit("vector").alias("origin")).distinct()
    new = table(spark, folder, "archetypes").select("source_id", F.lit("map").alias("origin")).distinct()
    return writers.upserted(old, new, "source_id")


# --- clusters, pages, streams ---


@query()
def same_night_clusters(spark: SparkSession, folder: str) -> DataFrame:
    rep, emb = reports(spark, folder), table(spark, folder, "nuforc_embeddings")
    return samenight.scored(samenight.members(rep, emb, LOOSE_NIGHT), rep, emb)


@query()
def archetype_assign(spark: SparkSession, folder: str) -> DataFrame:
    return archetypes.assigned(table(spark, folder, "nuforc_embeddings"))


@query()
def archetype_profile(spark: SparkSession, folder: str) -> DataFrame:
    return archetypes.profiles(_labels(spark, folder), reports(spark, folder), table(spark, folder, "nuforc_embeddings"))


_LINE = "trim(regexp_replace(coalesce({0}, ''), '[\\s\\x{{00a0}}\\x{{1c}}-\\x{{1f}}\\x{{85}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))"


@query(f"""SELECT row_id, {_LINE.format('datetime')} AS occurred, '' AS reported, {_LINE.format('date_posted')} AS posted, '' AS location, {_LINE.format('shape')} AS shape, {_LINE.format('duration_hours')} AS duration, '' AS characteristics,
array_to_string(list_filter(list_transform(string_split(coalesce(comments, ''), chr(10)), lambda x: {_LINE.format('x')}), lambda x: x <> ''), chr(10)) AS narrative FROM nuforc""")
def html_text(spark: SparkSession, folder: str) -> DataFrame:
    """Every report as a detail page and back: labels and narrative must survive."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "&", "&amp;"), "<", "&lt;")
    label = [F.concat(F.lit(f"<p>{n}: "), esc(c), F.lit("</p>")) for n, c in (("Occurred", "datetime"), ("Posted", "date_posted"), ("Shape", "shape"), ("Duration", "duration_hours"))]
    page = F.concat(F.lit("<html><head><script>x()</script></head><body><nav>menu</nav><main>"), *label, F.lit("<p>"), esc("comments"), F.lit("</p></main><footer>end</footer></body></html>"))
    return html.parse_details(table(spark, folder, "nuforc").select("row_id", page.alias("html")), "row_id")


_WEEKS = "SELECT event_type, cast(date_trunc('week', ts) AS DATE) AS week_start, cast(date_trunc('week', ts) AS DATE) + 6 AS week_end, count(*) AS reports FROM events GROUP BY 1, 2, 3"


@query(_WEEKS, dates=("week_start", "week_end"))
def stream_weekly(spark: SparkSession, folder: str) -> DataFrame:
    """The streaming operator over a static table, which gives the same weeks as the stream."""
    return bursts.weekly_counts(table(spark, folder, "events"))
