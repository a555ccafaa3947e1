"""Queries of sources, sinks, acquisition, places, the router and the event verdicts over whole tables, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportmill.functions import text
from reportmill.operators import acquire, archetypes, clean, crossref, density, encode, events, explore, flaps, samenight, signatures, vectors, vocab
from reportmill.params import DEFAULT
from reportmill.plans import reports as base
from reportmill.plans.reports import R, _values, query, reports
from reportmill.runtime import materialize, shared_folder, table
from reportmill.sources import html, readers, writers


def _written(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


# --- sources and sinks: written with the writers, read back with the readers ---

_RAW_COLUMNS = ("source_id", "datetime", "city", "state", "country", "shape", "comments", "date_posted")


def _raw_text(spark: SparkSession, folder: str) -> DataFrame:
    """The raw reports as texts without empty ones, which a CSV can't tell from nulls, and with one kind of line break."""
    t = table(spark, folder, "nuforc")
    blank = lambda c: F.nullif(F.regexp_replace(F.trim(F.col(c)), r"\r\n?", "\n"), F.lit("")).alias(c)
    return t.select(F.col("row_id").cast("string").alias("row_id"), *[blank(c) for c in _RAW_COLUMNS])


_RAW_SQL = "SELECT cast(row_id AS VARCHAR) AS row_id, " + ", ".join(f"nullif(regexp_replace(trim({c}), '\\r\\n?', chr(10), 'g'), '') AS {c}" for c in _RAW_COLUMNS) + " FROM nuforc"


@query(_RAW_SQL)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All raw reports written as CSV and read with the encoding test of every file."""
    path = _written(spark, "csv")
    _raw_text(spark, folder).write.options(header=True, escape='"', quoteAll=False, emptyValue="").csv(path)
    return readers.csv(spark, path)


@query(_RAW_SQL)
def latin_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """As Latin-1 files with a byte that is no UTF-8 in each."""
    path = _written(spark, "latin")
    _raw_text(spark, folder).withColumn("mark", F.lit("é")).repartition(2).write.options(header=True, escape='"', emptyValue="", encoding="ISO-8859-1").csv(path)
    got = readers.csv(spark, path)
    return got.where("mark = 'é'").drop("mark")


@query("SELECT row_id, source_id, city, shape FROM nuforc")
def jsonl_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """JSON lines, appended to, with a malformed and a blank line for each report."""
    path = _written(spark, "jsonl")
    t = table(spark, folder, "nuforc").select("row_id", "source_id", "city", "shape")
    writers.append_jsonl(t.where("row_id % 2 = 0"), path)
    writers.append_jsonl(t.where("row_id % 2 = 1"), path)
    t.select(F.explode(F.array(F.lit("{bad"), F.lit("  "))).alias("value")).write.mode("append").text(path)
    return readers.jsonl(spark, path, "row_id long, source_id string, city string, shape string")[0]


@query("SELECT 'kept' AS kind, count(*) AS n_lines FROM nuforc UNION ALL SELECT 'malformed', count(*) FROM nuforc")
def jsonl_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines a file of JSON lines keeps and loses."""
    path = _written(spark, "jsonl")
    t = table(spark, folder, "nuforc").select("row_id", "source_id")
    writers.append_jsonl(t, path)
    t.select(F.explode(F.array(F.lit("{bad"), F.lit(""))).alias("value")).write.mode("append").text(path)
    good, bad = readers.jsonl(spark, path, "row_id long, source_id string")
    return good.agg(F.count("*").alias("n_lines")).select(F.lit("kept").alias("kind"), "n_lines").union(bad.agg(F.count("*").alias("n_lines")).select(F.lit("malformed"), "n_lines"))


@query("SELECT trim(usps) AS usps, trim(name) AS name, try_cast(trim(intptlat) AS DOUBLE) AS intptlat, try_cast(trim(intptlong) AS DOUBLE) AS intptlong FROM gazetteer")
def gazetteer_tsv(spark: SparkSession, folder: str) -> DataFrame:
    """The gazetteer as a tab-separated file with blanks after its last header."""
    path = _written(spark, "tsv")
    g = table(spark, folder, "gazetteer").select(F.trim("usps").alias("USPS"), F.trim("name").alias("NAME"), F.trim("intptlat").alias("INTPTLAT"), F.trim("intptlong").alias("INTPTLONG    "))
    g.write.options(header=True, sep="\t", escape='"').csv(path)
    return readers.gazetteer_tsv(spark, path)


@query("SELECT row_id AS sighting_id, lower(trim(coalesce(shape, ''))) AS shape, upper(trim(coalesce(state, ''))) AS state, row_id % 7 = 0 AS is_tier1 FROM nuforc")
def html_index(spark: SparkSession, folder: str) -> DataFrame:
    """Every report as a row of an index page and back."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(c, "&", "&amp;"), "<", "&lt;")
    cell = lambda c: F.concat(F.lit("<td>"), esc(c), F.lit("</td>"))
    shape, state = F.lower(F.trim(F.coalesce("shape", F.lit("")))), F.upper(F.trim(F.coalesce("state", F.lit(""))))
    link = F.concat(F.lit('<td><a href="/sighting/?id='), F.col("row_id").cast("string"), F.lit('">Open'), F.when(F.col("row_id") % 7 == 0, " !").otherwise(""), F.lit("</a></td>"))
    row = F.concat(F.lit("<table><tr><th>x</th></tr><tr>"), link, F.lit("<td>1/1/2000</td><td></td>"), cell(state), F.lit("<td>USA</td>"), cell(shape), F.lit("<td>s</td><td>r</td><td></td></tr></table><table><tr><td>other</td></tr></table>"))
    return html.parse_index(table(spark, folder, "nuforc").select(row.alias("html"))).select("sighting_id", "shape", "state", "is_tier1")


@query("SELECT o_orderkey, trim(o_orderpriority) AS kind FROM orders WHERE trim(o_orderpriority) IN ('1-URGENT', '2-HIGH')")
def of_type(spark: SparkSession, folder: str) -> DataFrame:
    """A second dataset by the kinds that count."""
    t = table(spark, folder, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("Type"))
    return readers.of_type(t, ("1-URGENT", "2-HIGH")).select("o_orderkey", F.trim("Type").alias("kind"))


@query("SELECT source_id FROM nuforc_clean")
def optional_source(spark: SparkSession, folder: str) -> DataFrame:
    """A table joined with one that may be absent: absent reads as empty."""
    t = table(spark, folder, "nuforc_clean").select("source_id")
    return t.union(readers.parquet(spark, f"{folder}/no_such_table.parquet", "source_id string"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id >= 100 AND doc_id NOT IN (SELECT item_id FROM eval_items) ORDER BY doc_id LIMIT 200")
def work_list(spark: SparkSession, folder: str) -> DataFrame:
    """A portion of the ids that are not done yet, from a start on; the limit is the feature."""
    done = table(spark, folder, "eval_items").select(F.col("item_id").alias("doc_id"))
    return readers.work_list(readers.pending(table(spark, folder, "documents").select("doc_id"), done, "doc_id"), "doc_id", 100, 200)


@query("SELECT 1 AS files, count(*) AS n_rows, 'struct<state:string,state_name:string,lat:double,lon:double,tz:string>' AS schema FROM state_centroid")
def provenance(spark: SparkSession, folder: str) -> DataFrame:
    """What the provenance of a table says but for hash and time."""
    t = readers.parquet(spark, readers.required(spark, f"{folder}/state_centroid.parquet"))
    got = writers.provenance(spark, f"{folder}/state_centroid.parquet", t)
    return got.where("length(sha256) = 64 AND bytes > 0 AND acquired_at IS NOT NULL").groupBy("n_rows", "schema").agg(F.count("*").cast("int").alias("files"))


@query("SELECT row_id, source_id, city FROM nuforc")
def parquet_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """A table written, refused where it would overwrite what it reads, and read back."""
    path = _written(spark, "parquet")
    writers.parquet(table(spark, folder, "nuforc").select("row_id", "source_id", "city"), path)
    got = readers.parquet(spark, path)
    try:
        writers.parquet(got, path)
    except ValueError:
        return got
    raise RuntimeError("a table was written over what it reads")


@query(f"WITH {R} SELECT shape_norm, count(*) AS n_reports FROM reports GROUP BY 1")
def cached_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Counts from a view that is kept for an hour."""
    name = f"shapes_{abs(hash(folder))}"
    readers.cached_view(reports(spark, folder).select("shape_norm"), name)
    return spark.table(name).groupBy("shape_norm").agg(F.count("*").alias("n_reports"))


@query(f"WITH {base._JUDGED} SELECT count(*) AS n_rows FROM judged WHERE reason IS NULL")
def guarded_clean(spark: SparkSession, folder: str) -> DataFrame:
    """How many rows cleaning leaves; it is an error if none."""
    raw = readers.parquet(spark, readers.required(spark, f"{folder}/nuforc.parquet"))
    return readers.nonempty(clean.cleaned(raw), "cleaning").agg(F.count("*").alias("n_rows"))


@query("SELECT row_id, lower(trim(coalesce(shape, ''))) AS shape, true AS stamped FROM nuforc")
def details_stamped(spark: SparkSession, folder: str) -> DataFrame:
    """Detail pages with the time of the run."""
    shape = F.lower(F.trim(F.coalesce("shape", F.lit(""))))
    page = F.concat(F.lit("<main><p>Shape: "), F.regexp_replace(F.regexp_replace(shape, "&", "&amp;"), "<", "&lt;"), F.lit("</p><p>text</p></main>"))
    got = html.parse_details(table(spark, folder, "nuforc").select("row_id", page.alias("html")), "row_id", stamp=True)
    return got.select("row_id", "shape", F.col("scraped_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ$").alias("stamped"))


# --- acquisition ---


@query("""SELECT row_id, datetime, city, state, shape, CASE WHEN isfinite(duration_seconds) OR duration_seconds IS NULL THEN duration_seconds END AS duration_seconds, comments, date_posted, longitude, NULL::VARCHAR AS country,
substr(sha1(coalesce(datetime, 'nan') || '|' || coalesce(city, 'nan') || '|' || coalesce(state, 'nan') || '|' || substr(coalesce(comments, 'nan'), 1, 200)), 1, 16) AS own_id FROM nuforc""")
def normalized_extract(spark: SparkSession, folder: str) -> DataFrame:
    """An extract under the headers of a variant, one canonical column missing and one extra: detected, renamed, filled, given ids."""
    t = table(spark, folder, "nuforc")
    raw = t.select(
        "row_id", "datetime", "city", "state", "shape", F.when(~F.isnan("duration_seconds"), F.col("duration_seconds")).cast("string").alias("duration (seconds)"), F.col("duration_hours").alias("duration (hours/min)"),
        "comments", F.col("date_posted").alias("date posted"), "latitude", F.col("longitude").cast("string").alias("longitude "),
    )
    out = acquire.normalize(raw, acquire.detect_schema(raw.columns))
    return out.select("row_id", "datetime", "city", "state", "shape", "duration_seconds", "comments", "date_posted", "longitude", "country", F.col("source_id").alias("own_id"))


@query(f"SELECT * FROM {_values([('scrubbed_v1', 11), ('scrubbed_v2', 11), ('renner_csv', 10), ('kcimc_v1', 9)])} t(variant, n_headers)")
def header_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Each variant's own headers are told apart."""
    found = [(acquire.detect_schema(list(heads)), len(heads)) for heads in acquire.HEADER_VARIANTS.values()]
    return spark.createDataFrame(found, "variant string, n_headers int")


@query("""WITH d AS (SELECT row_id AS id, nullif(datetime, '') AS occurred, shape, comments, coalesce(city, '') || ', ' || coalesce(state, '') AS location FROM nuforc ),
i AS (SELECT row_id AS id, date_posted AS reported, 'x' || row_id AS summary, row_id % 5 = 0 AS is_tier1 FROM nuforc WHERE row_id % 2 = 0)
SELECT d.occurred AS datetime, d.shape, coalesce(d.comments, i.summary) AS comments, i.reported AS date_posted, coalesce(i.is_tier1, false) AS tier1 FROM d LEFT JOIN i USING (id)""")
def scrape_joined(spark: SparkSession, folder: str) -> DataFrame:
    """Detail records of all reports with an index of every second one."""
    t = table(spark, folder, "nuforc")
    detail = t.select(F.col("row_id").alias("sighting_id"), F.nullif("datetime", F.lit("")).alias("occurred"), "shape", F.col("comments").alias("narrative"), F.concat(F.coalesce("city", F.lit("")), F.lit(", "), F.coalesce("state", F.lit(""))).alias("location"), F.lit(None).cast("string").alias("posted"))
    index = t.where("row_id % 2 = 0").select(F.col("row_id").alias("sighting_id"), F.col("date_posted").alias("reported"), F.concat(F.lit("x"), F.col("row_id").cast("string")).alias("summary"), (F.col("row_id") % 5 == 0).alias("is_tier1"), F.col("city").alias("city"))
    return acquire.scrape_joined(detail, index).select("datetime", "shape", "comments", "date_posted", "tier1")


_TITLED = "array_to_string(list_transform(generate_series(1, len({0})), lambda i: CASE WHEN i = 1 OR NOT regexp_matches({0}[i - 1], '\\p{{L}}') THEN upper({0}[i]) ELSE {0}[i] END), '')"


@query(f"SELECT c AS city, {_TITLED.format('lower(c)')} AS title, count(*) AS n_rows FROM (SELECT coalesce(city, '') AS c FROM nuforc) GROUP BY 1")
def city_titles(spark: SparkSession, folder: str) -> DataFrame:
    city = F.coalesce("city", F.lit(""))
    return table(spark, folder, "nuforc").groupBy(city.alias("city")).agg(F.count("*").alias("n_rows")).withColumn("title", text.title_case(F.col("city")))


@query(f"WITH {R} SELECT source_id, substr(narrative, 1, 2000) AS long_excerpt, substr(narrative, 1, 300) AS middle, substr(narrative, 1, 200) AS short FROM reports")
def excerpts(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("narrative")
    return reports(spark, folder).select("source_id", text.excerpt(n, 2000).alias("long_excerpt"), text.excerpt(n, 300).alias("middle"), text.excerpt(n, 200).alias("short"))


@query(f"WITH {R} SELECT source_id, CASE WHEN length(narrative) <= 200 THEN narrative ELSE regexp_replace(substr(narrative, 1, 200), ' [^ ]*$', '', 's') || '...' END AS shortened FROM reports")
def word_safe(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).select("source_id", text.word_safe(F.col("narrative")).alias("shortened"))


@query(f"WITH {R} SELECT strftime(event_date, '%b %Y') AS month, count(*) AS n_reports FROM reports WHERE event_date IS NOT NULL GROUP BY 1")
def month_labels(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).where("event_date IS NOT NULL").groupBy(text.month_label(F.col("event_date")).alias("month")).agg(F.count("*").alias("n_reports"))


@query(f"WITH {R} SELECT source_id, len(regexp_split_to_array(lower(narrative), 'light')) * 2 - 1 AS n_parts FROM reports")
def highlighted(spark: SparkSession, folder: str) -> DataFrame:
    return reports(spark, folder).select("source_id", F.size(text.highlighted(F.col("narrative"), "Light")).cast("long").alias("n_parts"))


@query("""SELECT file_id, row_no, CASE WHEN json_valid(body) THEN len(json_keys(CASE WHEN json_valid(body) THEN body END)) END AS n_keys FROM (SELECT file_id, row_no, regexp_extract('Here: ' || coalesce(payload, '') || ' end', '\\{.*\\}', 0, 's') AS body FROM raw_rows)""")
def json_salvaged(spark: SparkSession, folder: str) -> DataFrame:
    """The JSON object found inside a longer answer."""
    said = F.concat(F.lit("Here: "), F.coalesce("payload", F.lit("")), F.lit(" end"))
    body = F.from_json(text.salvaged(said), "map<string,variant>")
    return table(spark, folder, "raw_rows").select("file_id", "row_no", F.when(body.isNotNull(), F.size(F.map_keys(body)).cast("long")).alias("n_keys"))


@query("SELECT DISTINCT state, sha256(lower(trim(' ' || state_name || ' ')) || state) AS key FROM state_centroid")
def cache_keys(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "state_centroid").select("state", text.cache_key(F.concat(F.lit(" "), "state_name", F.lit(" ")), F.col("state")).alias("key")).distinct()


@query(f"WITH {base._JUDGED} SELECT cast(floor(year(event_dt) / 10) * 10 AS INT) AS event_decade, count(*) AS n_rows FROM judged WHERE reason IS NULL GROUP BY 1")
def clean_decades(spark: SparkSession, folder: str) -> DataFrame:
    """The per-decade part of the cleaning report."""
    return clean.cleaned(table(spark, folder, "nuforc")).groupBy("event_decade").agg(F.count("*").alias("n_rows"))


# --- places ---


@query(f"WITH {base._LOCATED} SELECT coalesce(geocode_method, 'none') AS method, count(*) AS n_rows, round(count(*) * 100 / (SELECT count(*) FROM located), 1) AS pct FROM located GROUP BY 1")
def geocode_report(spark: SparkSession, folder: str) -> DataFrame:
    located = base._located(spark, folder).select(F.coalesce("geocode_method", F.lit("none")).alias("method"))
    return explore.top(located, "method", 10).select("method", F.col("n_reports").alias("n_rows"), "pct")


@query(f"WITH {R} SELECT source_id, latitude, longitude FROM reports WHERE geocode_method = 'exact' AND latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY md5(source_id || ':42'), source_id LIMIT 10000")
def exact_map_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The points of the map page: exactly placed reports, at most 10,000 of them by a seeded sample (the page's feature)."""
    return explore.sampled(explore.exactly_placed(reports(spark, folder)), 10_000).select("source_id", "latitude", "longitude")


def _names(spark: SparkSession, folder: str) -> list[tuple[str, str]]:
    """The 51 states by name."""
    return [(r.state_name, r.state) for r in table(spark, folder, "state_centroid").orderBy("state_name").collect()]


_PLACE = """st AS (SELECT state AS code, lower(state_name) AS name, row_number() OVER (ORDER BY state_name) AS o FROM state_centroid),
ls AS (SELECT row_id, trim(CASE row_id % 4 WHEN 0 THEN coalesce(city, '') || ', ' || upper(coalesce(state, '')) WHEN 1 THEN coalesce(city, '') || ', ' || coalesce((SELECT name FROM st WHERE code = upper(trim(coalesce(state, '')))), 'Kabul')
  WHEN 2 THEN coalesce(city, '') || ' ' || upper(coalesce(state, '')) ELSE 'Man in a field, or nearby ' || coalesce(city, '') END) AS s FROM nuforc),
lg AS (SELECT *, regexp_extract(s, '^(.+?),\\s*([A-Z]{2})$', 1) AS gc, regexp_extract(s, '^(.+?),\\s*([A-Z]{2})$', 2) AS gs, (SELECT arg_min(name, o) FROM st WHERE contains(lower(s), name)) AS nm, (SELECT min(code) FROM st WHERE contains(s, ', ' || code) OR suffix(s, ' ' || code)) AS cd FROM ls),
lp AS (SELECT row_id, s, CASE WHEN gs IN (SELECT code FROM st) THEN 1 WHEN nm IS NOT NULL THEN 2 WHEN cd IS NOT NULL THEN 3 ELSE 4 END AS how, gc, gs, nm, cd, trim(replace(lower(s), coalesce(nm, 'zzzz'), ''), ' ,') AS rest FROM lg)"""


@query(f"WITH {_PLACE} SELECT row_id, CASE how WHEN 1 THEN trim(gc) WHEN 2 THEN {_TITLED.format('rest')} WHEN 3 THEN trim(replace(replace(s, ', ' || cd, ''), ' ' || cd, '')) ELSE '' END AS place_city, CASE how WHEN 1 THEN gs WHEN 2 THEN (SELECT min(code) FROM st WHERE name = nm) WHEN 3 THEN cd ELSE '' END AS place_state FROM lp")
def incident_places(spark: SparkSession, folder: str) -> DataFrame:
    """City and state out of location texts of four forms made of every report's place."""
    t, names = table(spark, folder, "nuforc"), _names(spark, folder)
    city, state = F.coalesce("city", F.lit("")), F.coalesce("state", F.lit(""))
    full = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for n, c in names for x in (c, n.lower())]), F.upper(F.trim(state))), F.lit("Kabul"))
    form = F.when(F.col("row_id") % 4 == 0, F.concat(city, F.lit(", "), F.upper(state))).when(F.col("row_id") % 4 == 1, F.concat(city, F.lit(", "), full)).when(F.col("row_id") % 4 == 2, F.concat(city, F.lit(" "), F.upper(state)))
    located = t.select("row_id", form.otherwise(F.concat(F.lit("Man in a field, or nearby "), city)).alias("said"))
    c, s = crossref.incident_place(F.col("said"), names)
    return located.select("row_id", c.alias("place_city"), s.alias("place_state"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE cast(o_orderdate AS DATE) END AS day FROM orders""", dates=("day",))
def incident_dates(spark: SparkSession, folder: str) -> DataFrame:
    """Dates written in several forms, two-digit years among them, and N/A."""
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    said = F.when(k == 0, F.date_format(d, "M/d/yy")).when(k == 1, F.date_format(d, "MM/dd/yyyy")).when(k == 2, F.date_format(d, "yyyy-MM-dd")).when(k == 3, F.date_format(d, "MMMM d, yyyy")).otherwise("N/A")
    return table(spark, folder, "orders").select("o_orderkey", crossref.incident_date(said).alias("day"))


# --- explorer ---


@query(f"WITH {R} SELECT source_id, event_date, row_number() OVER (ORDER BY event_date NULLS LAST, source_id) - 1 AS place FROM reports", dates=("event_date",))
def listed_by_date(spark: SparkSession, folder: str) -> DataFrame:
    return explore.listed(reports(spark, folder).select("source_id", "event_date"), "event_date")


@query(f"WITH {R} SELECT source_id, shape_norm, row_number() OVER (ORDER BY shape_norm, source_id) - 1 AS place FROM reports")
def listed_by_shape(spark: SparkSession, folder: str) -> DataFrame:
    return explore.listed(reports(spark, folder).select("source_id", "shape_norm"), "shape_norm")


@query(f"WITH {base._MERGED}, p AS (SELECT term, arg_max(time_bin, rate_per_1k * 100000 - time_bin / 100000) AS peak_bin FROM merged GROUP BY 1) SELECT term, peak_bin, row_number() OVER (ORDER BY peak_bin, term) AS place FROM p")
def vocab_by_peak(spark: SparkSession, folder: str) -> DataFrame:
    """Terms in the order of their peaks; one row per term of the vocabulary."""
    from pyspark.sql import Window

    peaks = vocab.peaks(base.vocab_merged(spark, folder)).select("term", "peak_bin")
    return peaks.withColumn("place", F.row_number().over(Window.orderBy("peak_bin", "term")))


@query(f"WITH {base._LABELS}, c AS (SELECT archetype, count(*) AS n_reports FROM lab GROUP BY 1) SELECT archetype, n_reports, round(6 + sqrt(n_reports / max(n_reports) OVER ()) * 26, 4) AS radius FROM c")
def archetype_bubbles(spark: SparkSession, folder: str) -> DataFrame:
    return explore.bubbles(explore.counts(base._labels(spark, folder), "archetype"), "n_reports")


@query(f"WITH {R}, {base._LABELS} SELECT archetype, place, source_id, narrative FROM (SELECT archetype, source_id, narrative, row_number() OVER (PARTITION BY archetype ORDER BY source_id) AS place FROM lab JOIN reports USING (source_id) WHERE narrative <> '') WHERE place <= 3")
def archetype_narratives(spark: SparkSession, folder: str) -> DataFrame:
    return explore.narratives_of(base._labels(spark, folder), reports(spark, folder), "archetype")


#: Queries typed into the explorer, one for each stage of the router and one that none knows.
ASKED = [" Arizona ", "tx", "Triangle", "A3", "2014", "phoenix", "flying saucer", "wash", "orang", "zzzz", "1700"]


def _stages(spark: SparkSession, folder: str) -> list:
    rep, cat = reports(spark, folder), events.catalog(spark)
    states = table(spark, folder, "state_centroid").select(F.col("state").alias("label"), F.explode(F.array("state", "state_name")).alias("term"))
    shapes = rep.where("shape_norm <> ''").select(F.col("shape_norm").alias("label"), F.col("shape_norm").alias("term")).distinct()
    own = base._labels(spark, folder).join(rep.where("shape_norm <> ''").select("source_id", "shape_norm"), "source_id").groupBy("archetype", "shape_norm").agg(F.count("*").alias("n"))
    top = own.groupBy("archetype").agg(F.min_by("shape_norm", F.struct(-F.col("n"), "shape_norm")).alias("shape"))
    label = F.concat(F.lit("A"), F.col("archetype").cast("string"))
    arch = top.select(label.alias("label"), label.alias("term"), F.lit(True).alias("exact")).union(top.select(label, F.concat(F.lit("mostly "), "shape"), F.lit(False)))
    years = rep.where("event_year IS NOT NULL").select(F.col("event_year").cast("string").alias("label")).distinct().withColumn("term", F.col("label"))
    named = cat.select(F.col("event").alias("label"), F.col("event").alias("term"))
    terms = spark.createDataFrame([(t, t) for t in vocab.VOCABULARY], "label string, term string")
    return explore.router_stages(states, shapes, arch, years, named, terms, named)


_ASKED = "asked(keyword, k) AS " + _values([(k, k.strip().lower()) for k in ASKED])
_ROUTE = f"""{R}, {base._LABELS}, {_ASKED}, ar AS (SELECT 'A' || archetype AS label, arg_min(shape_norm, rn) AS shape FROM (SELECT archetype, shape_norm, row_number() OVER (PARTITION BY archetype ORDER BY count(*) DESC, shape_norm) AS rn FROM lab JOIN reports USING (source_id) WHERE shape_norm <> '' GROUP BY 1, 2) GROUP BY archetype),
ts(place, kind, label, term, whole) AS (SELECT 0, 'state', state, lower(state), true FROM state_centroid UNION ALL SELECT 0, 'state', state, lower(state_name), true FROM state_centroid UNION ALL SELECT DISTINCT 1, 'shape', shape_norm, lower(shape_norm), true FROM reports WHERE shape_norm <> ''
UNION ALL SELECT 2, 'archetype', label, lower(label), true FROM ar UNION ALL SELECT 3, 'archetype', label, 'mostly ' || lower(shape), false FROM ar UNION ALL SELECT DISTINCT 4, 'year', cast(event_year AS VARCHAR), cast(event_year AS VARCHAR), true FROM reports WHERE event_year BETWEEN 1905 AND 2023
UNION ALL SELECT 5, 'event', event, lower(event), false FROM {_values([(e[0],) for e in events.CATALOG])} e(event) UNION ALL SELECT 6, 'term', t, t, true FROM {_values([(t,) for t in vocab.VOCABULARY])} v(t)
UNION ALL SELECT 7, 'state', state, lower(state), false FROM state_centroid UNION ALL SELECT 7, 'state', state, lower(state_name), false FROM state_centroid UNION ALL SELECT 9, 'term', t, t, false FROM {_values([(t,) for t in vocab.VOCABULARY])} v(t)),
hit AS (SELECT keyword, place, kind, min(label) AS label FROM asked JOIN ts ON CASE WHEN whole THEN lower(term) = k ELSE contains(lower(term), k) END GROUP BY 1, 2, 3),
route AS (SELECT keyword, kind, label FROM (SELECT *, row_number() OVER (PARTITION BY keyword ORDER BY place) AS rn FROM hit) WHERE rn = 1)"""


@query(f"WITH {_ROUTE} SELECT * FROM route")
def keyword_route(spark: SparkSession, folder: str) -> DataFrame:
    """What each typed query is taken for, by nine stages in turn."""
    return explore.routed(ASKED, _stages(spark, folder))


@query(f"WITH {_ROUTE} SELECT keyword, kind, label, count(*) AS n_reports FROM route JOIN reports ON (kind = 'state' AND state = label) OR (kind = 'shape' AND shape_norm = label) OR (kind = 'year' AND cast(event_year AS VARCHAR) = label) GROUP BY 1, 2, 3")
def route_context(spark: SparkSession, folder: str) -> DataFrame:
    """How many reports belong to the states, shapes and years the queries were taken for."""
    route = materialize(explore.routed(ASKED, _stages(spark, folder)), "route")
    rep = reports(spark, folder).select("source_id", "state", "shape_norm", "event_year")
    parts = [explore.context(route, kind, rep, on).groupBy("keyword", "label").agg(F.count("*").alias("n_reports")).withColumn("kind", F.lit(kind)) for kind, on in (("state", "state"), ("shape", "shape_norm"), ("year", "event_year"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- bursts ---


@query(f"""WITH {base._INSIDE}, {base._UNITS}, fl AS (SELECT x.state, x."start", generate_subscripts(u, 1) AS i, unnest(u) AS v FROM x JOIN un USING (source_id)), s AS (SELECT state, "start", i, sum(v) AS s, count(*) AS n FROM fl GROUP BY 1, 2, 3),
co AS (SELECT state, "start", round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 0 END, 4) AS coherence FROM s GROUP BY 1, 2) SELECT en.state, en."start", n_reports, coalesce(coherence, 0) AS coherence FROM en LEFT JOIN co USING (state, "start")""", dates=("start",))
def flap_coherence(spark: SparkSession, folder: str) -> DataFrame:
    rows = base._rows(spark, folder)
    islands = materialize(base._islands(spark, folder), "flaps")
    return flaps.enriched(rows, islands, table(spark, folder, "nuforc_embeddings")).select("state", "start", "n_reports", "coherence")


@query(f"WITH {base._flap(DEFAULT)} SELECT * FROM b", dates=("week_start", "week_end"))
def burst_weeks_default(spark: SparkSession, folder: str) -> DataFrame:
    """At the default gates, which the small tables hardly reach."""
    return flaps.bursts(flaps.eligible(reports(spark, folder)))


@query(f"WITH {base._flap(DEFAULT)} SELECT * FROM f", dates=("start", "end"))
def flap_islands_default(spark: SparkSession, folder: str) -> DataFrame:
    return flaps.islands(flaps.bursts(flaps.eligible(reports(spark, folder))))


@query(f"""WITH {base._INSIDE}, t AS (SELECT year(peak_date) AS event_year, count(*) AS n FROM (SELECT * FROM en ORDER BY n_reports DESC, state, "start" LIMIT 15) GROUP BY 1) SELECT r.event_year, r.n_reports, coalesce(t.n, 0) AS n_marks
FROM (SELECT event_year, count(*) AS n_reports FROM reports WHERE event_year IS NOT NULL GROUP BY 1) r LEFT JOIN t USING (event_year)""")
def top_flap_marks(spark: SparkSession, folder: str) -> DataFrame:
    """The yearly series with the 15 largest bursts marked (the chart's feature)."""
    top = flaps.enriched(base._rows(spark, folder), base._islands(spark, folder)).orderBy(F.desc("n_reports"), "state", "start").limit(15)
    return explore.yearly(reports(spark, folder), top.select(F.year("peak_date").alias("event_year")))


@query(f"""WITH {base._INSIDE} SELECT st.state AS label, cc.state, cc."start" FROM cc JOIN state_centroid st ON list_contains(s, st.state)""", dates=("start",))
def flaps_beside_state(spark: SparkSession, folder: str) -> DataFrame:
    """For each state the bursts elsewhere that it shares days with."""
    near = flaps.concurrent(base._islands(spark, folder)).select("state", "start", F.explode("concurrent_states").alias("label"))
    return near.join(F.broadcast(table(spark, folder, "state_centroid").select(F.col("state").alias("label"))), "label")


@query(f"""WITH {base._INSIDE}, {base._EVENTS} SELECT event, count(*) AS n_flaps FROM ev JOIN cc ON list_has_any(s, states) GROUP BY 1""")
def events_beside_flaps(spark: SparkSession, folder: str) -> DataFrame:
    """For each event with states the bursts that share days with any burst of those states."""
    near = flaps.concurrent(base._islands(spark, folder))
    listed = F.broadcast(events.catalog(spark).where("states IS NOT NULL").select("event", "states"))  # the catalog of this module
    return near.join(listed, F.arrays_overlap("concurrent_states", "states")).groupBy("event").agg(F.count("*").alias("n_flaps"))


# --- events ---

#: Reports of one date and state taken as a cluster, a grouping SQL can express, where the average-linkage clusters would stand.
_NIGHT = "cl AS (SELECT event_date, state AS cluster_key, source_id FROM (SELECT event_date, state, source_id, count(*) OVER (PARTITION BY event_date, state) AS n FROM reports WHERE event_date IS NOT NULL AND state <> '') WHERE n >= 2)"


def _by_state(rep: DataFrame) -> DataFrame:
    n = rep.where("event_date IS NOT NULL AND state <> ''").groupBy("event_date", "state").agg(F.count("*").alias("n")).where("n >= 2")
    return rep.join(n, ["event_date", "state"]).select("event_date", F.col("state").alias("cluster_key"), "source_id")


_EXPECTED = "xp(position, event, expected) AS " + _values([(i, e[0], p) for i, e in enumerate(events.CATALOG) for p in (e[5] or [""])])
_PHRASES = f"""{_EXPECTED}, sn AS (SELECT event AS sig_event, min(position) AS o FROM sg JOIN xp USING (event) GROUP BY 1),
nm AS (SELECT x.event, arg_min(sig_event, o) AS sig_event FROM (SELECT DISTINCT event FROM xp) x JOIN sn ON contains(lower(sig_event), string_split(lower(x.event), ' ')[1]) OR contains(lower(sig_event), string_split(lower(x.event), ' ')[2]) GROUP BY 1),
tp AS (SELECT event AS sig_event, arg_min(phrase, rn) AS top, max(distinctiveness) AS score FROM (SELECT *, row_number() OVER (PARTITION BY event ORDER BY distinctiveness DESC, phrase) AS rn FROM sg) GROUP BY 1),
mt AS (SELECT xp.event, count(*) AS n FROM xp JOIN nm USING (event) WHERE expected <> '' AND EXISTS (SELECT 1 FROM sg WHERE sg.event = nm.sig_event AND contains(lower(sg.phrase), lower(expected))) GROUP BY 1),
ph AS (SELECT ev.event, nm.sig_event IS NOT NULL AS sig_found, cast(coalesce(mt.n, 0) AS INT) AS sig_phrases_matched, coalesce(tp.top, '') AS sig_top_phrase, coalesce(tp.score, 0.0) AS sig_top_score FROM ev LEFT JOIN nm USING (event) LEFT JOIN mt USING (event) LEFT JOIN tp USING (sig_event))"""
_VERDICT = f"""{base._FLAP_MET}, known AS (SELECT event, source_id FROM em), {base._sig('event')}, {_PHRASES}, {_NIGHT},
cm AS (SELECT event, event_date, cluster_key, count(*) AS n, bool_or(states IS NULL OR list_contains(states, reports.state)) AS here FROM cl JOIN reports USING (source_id, event_date) JOIN ev ON event_date BETWEEN e0 AND e1 GROUP BY 1, 2, 3),
ce AS (SELECT event, count(*) AS cluster_count, max(n) AS cluster_max_size FROM cm GROUP BY 1 HAVING bool_or(here)),
mx AS (SELECT ev.event, ev.kind, corpus_reports, top_shape, shape_matches, coalesce(cluster_count, 0) AS cluster_count, coalesce(cluster_max_size, 0) AS cluster_max_size, coalesce(flap_count, 0) AS flap_count, coalesce(flap_max_reports, 0) AS flap_max_reports,
  coalesce(flap_peak_ratio, 0) AS flap_peak_ratio, sig_found, sig_phrases_matched, sig_top_phrase, sig_top_score,
  cast(coalesce(cluster_count, 0) > 0 AS INT) + cast(coalesce(flap_count, 0) > 0 AS INT) + cast(sig_found AS INT) + cast(shape_matches AS INT) AS detections_out_of_4
  FROM ev JOIN cov USING (event) LEFT JOIN ce USING (event) LEFT JOIN fm USING (event) JOIN ph USING (event)),
vd AS (SELECT *, CASE WHEN detections_out_of_4 >= 2 THEN 'PASS' WHEN detections_out_of_4 >= 1 THEN 'PARTIAL' ELSE 'MISS' END AS status FROM mx)"""


def _verdict(spark: SparkSession, folder: str) -> DataFrame:
    rep, cat = reports(spark, folder), events.catalog(spark)
    islands = materialize(base._islands(spark, folder), "flaps")
    found = materialize(signatures.signatures(rep, events.members(rep, cat), "event"), "signatures")
    return events.matrix(rep, cat, _by_state(rep), flaps.enriched(base._rows(spark, folder), islands), found)


@query(f"WITH {R}, {base._COVER}, known AS (SELECT event, source_id FROM em), {base._sig('event')}, {_PHRASES} SELECT * FROM ph")
def event_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """Signatures of the catalog's events matched to them by name, and the expected phrases found."""
    rep, cat = reports(spark, folder), events.catalog(spark)
    return events.phrases_met(materialize(signatures.signatures(rep, events.members(rep, cat), "event"), "signatures"), cat)


@query(f"WITH {_VERDICT} SELECT * FROM vd")
def event_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """The event matrix with its verdicts, over clusters that SQL can form too."""
    return _verdict(spark, folder)


@query(f"WITH {_VERDICT} SELECT kind, count(*) AS n_events, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'PARTIAL') AS partial, count(*) FILTER (status = 'MISS') AS missed, round(count(*) FILTER (status = 'PASS') * 100 / count(*), 1) AS pct_passed FROM vd GROUP BY ROLLUP (kind)")
def verdict_totals(spark: SparkSession, folder: str) -> DataFrame:
    return events.verdicts(_verdict(spark, folder))


@query(f"WITH {_VERDICT} SELECT kind, count(*) AS n_events, count(*) FILTER (cluster_count > 0) AS by_cluster, count(*) FILTER (flap_count > 0) AS by_flap, count(*) FILTER (sig_found) AS by_phrase, count(*) FILTER (shape_matches) AS by_shape FROM vd GROUP BY ROLLUP (kind)")
def method_totals(spark: SparkSession, folder: str) -> DataFrame:
    return explore.detections(_verdict(spark, folder))


_TOP_CLUSTERS = f"""{R}, {_NIGHT}, tc AS (SELECT event_date, cluster_key FROM cl GROUP BY 1, 2 ORDER BY count(*) DESC, event_date, cluster_key LIMIT 50),
known AS (SELECT strftime(event_date, '%Y-%m-%d') || ' ' || cluster_key AS cluster_id, source_id FROM cl JOIN tc USING (event_date, cluster_key)), {base._sig('cluster_id', 10)}"""


def _cluster_signatures(spark: SparkSession, folder: str) -> DataFrame:
    rep = reports(spark, folder)
    return signatures.of_top_clusters(rep, _by_state(rep))


@query(f"WITH {_TOP_CLUSTERS} SELECT * FROM sg")
def cluster_signatures(spark: SparkSession, folder: str) -> DataFrame:
    """Ten phrases of each of the 50 largest clusters (the report's feature)."""
    return _cluster_signatures(spark, folder)


@query(f"WITH {R}, {base._COVER}, known AS (SELECT event, source_id FROM em), {base._sig('event')}, a AS MATERIALIZED (SELECT * FROM sg) SELECT event, NULL::VARCHAR AS cluster_id, phrase, n_reports FROM a UNION ALL BY NAME SELECT NULL::VARCHAR AS event, cluster_id, phrase, n_reports FROM (WITH {_TOP_CLUSTERS} SELECT * FROM sg)")
def signature_tables_united(spark: SparkSession, folder: str) -> DataFrame:
    """The signatures of events and clusters in one table, each without the other's key."""
    rep = reports(spark, folder)
    one = signatures.signatures(rep, events.members(rep, events.catalog(spark)), "event").select("event", "phrase", "n_reports")
    two = _cluster_signatures(spark, folder).select("cluster_id", "phrase", "n_reports")
    return one.unionByName(two, allowMissingColumns=True)


_UNIT_ROWS = f"{base._UNITS}"


@query(f"""WITH {R}, {_UNIT_ROWS}, {_NIGHT}, m AS (SELECT event_date, cluster_key, source_id, state, shape_norm, u FROM cl JOIN reports USING (source_id, event_date) JOIN un USING (source_id)),
fl AS (SELECT event_date, cluster_key, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM m), s AS (SELECT event_date, cluster_key, i, sum(x) AS s, count(*) AS n FROM fl GROUP BY 1, 2, 3),
co AS (SELECT event_date, cluster_key, CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 1 END AS sim FROM s GROUP BY 1, 2)
SELECT m.event_date, m.cluster_key, count(*) AS n_reports, count(DISTINCT state) AS n_states, round(any_value(sim), 4) AS mean_cosine_sim, round(0.3 * least(count(*) / 10, 1) + 0.3 * least(count(DISTINCT state) / 5, 1) + 0.4 * any_value(sim), 4) AS score FROM m JOIN co USING (event_date, cluster_key) GROUP BY 1, 2""", dates=("event_date",))
def cluster_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes, similarity and score of clusters of one date, over clusters that SQL can form too."""
    rep, emb = reports(spark, folder), table(spark, folder, "nuforc_embeddings")
    got = samenight.scored(_by_state(rep), rep, emb)
    return got.select("event_date", "cluster_key", "n_reports", "n_states", "mean_cosine_sim", "score")


@query(f"""WITH {R}, {base._LABELS}, {_UNIT_ROWS}, o AS (SELECT archetype, source_id, state, shape_norm, event_year FROM lab JOIN reports USING (source_id)),
sh AS (SELECT archetype, string_agg(shape_norm, ', ' ORDER BY rn) AS top_3_shapes FROM (SELECT archetype, shape_norm, row_number() OVER (PARTITION BY archetype ORDER BY count(*) DESC, shape_norm) AS rn FROM o WHERE shape_norm <> '' GROUP BY 1, 2) WHERE rn <= 3 GROUP BY 1),
de AS (SELECT archetype, arg_max(d, n * 100000 - d) AS peak_decade FROM (SELECT archetype, cast(event_year // 10 * 10 AS INT) AS d, count(*) AS n FROM o WHERE event_year IS NOT NULL GROUP BY 1, 2) GROUP BY 1),
fl AS (SELECT archetype, generate_subscripts(u, 1) AS i, unnest(u) AS x FROM un JOIN lab USING (source_id)), s AS (SELECT archetype, i, sum(x) AS s, count(*) AS n FROM fl GROUP BY 1, 2),
co AS (SELECT archetype, round(CASE WHEN max(n) > 1 THEN (sum(s * s) - max(n)) / (max(n) * (max(n) - 1)) ELSE 1 END, 4) AS mean_cosine_sim FROM s GROUP BY 1)
SELECT archetype, count(*) AS n_reports, round(count(*) * 100 / (SELECT count(*) FROM reports), 1) AS pct_of_corpus, any_value(string_split(top_3_shapes, ', ')[1]) AS top_shape, any_value(top_3_shapes) AS top_3_shapes, any_value(peak_decade) AS peak_decade,
count(DISTINCT nullif(state, '')) AS n_states, any_value(mean_cosine_sim) AS mean_cosine_sim FROM o LEFT JOIN sh USING (archetype) LEFT JOIN de USING (archetype) LEFT JOIN co USING (archetype) GROUP BY 1""")
def archetype_profile_measures(spark: SparkSession, folder: str) -> DataFrame:
    """The profile of each archetype but for its medoid, which centroid_medoid checks."""
    return archetypes.profiles(base._labels(spark, folder), reports(spark, folder), table(spark, folder, "nuforc_embeddings")).drop("medoid")


@query(f"WITH {R}, {_NIGHT} SELECT event_date, cluster_key, array_to_string(list_sort(list(shape_norm || '=' || n)), ', ') AS shapes FROM (SELECT event_date, cluster_key, shape_norm, count(*) AS n FROM cl JOIN reports USING (source_id, event_date) GROUP BY 1, 2, 3) GROUP BY 1, 2", dates=("event_date",))
def cluster_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """The shapes of each cluster with their counts."""
    rep = reports(spark, folder)
    shapes = samenight.shape_counts(_by_state(rep).join(rep.select("source_id", "shape_norm"), "source_id"), ["event_date", "cluster_key"])
    said = F.array_join(F.array_sort(F.transform(F.map_entries("shapes"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ", ")
    return shapes.select("event_date", "cluster_key", said.alias("shapes"))


# --- vectors and groups without SQL ---


@query()
def same_night_default(spark: SparkSession, folder: str) -> DataFrame:
    """At the default distance and sizes."""
    rep, emb = reports(spark, folder), table(spark, folder, "nuforc_embeddings")
    return samenight.scored(samenight.members(rep, emb), rep, emb)


@query(f"WITH {R} SELECT source_id, 384 AS dim, CASE WHEN regexp_matches(lower(narrative), '\\b[a-z][a-z]+\\b') THEN 1.0 ELSE 0.0 END AS length FROM reports")
def embed_hashing(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors of all narratives by the default encoder: their dimension and length."""
    got = encode.encoded(reports(spark, folder))
    return got.select("source_id", F.size("embedding").alias("dim"), F.round(vectors.norm(F.col("embedding")), 4).alias("length"))


@query("""SELECT source_id FROM nuforc_clean UNION SELECT source_id FROM nuforc_embeddings WHERE source_id IS NOT NULL""")
def embed_refreshed(spark: SparkSession, folder: str) -> DataFrame:
    """The cached vectors with those of the reports it lacks."""
    cache = table(spark, folder, "nuforc_embeddings").where("embedding IS NOT NULL").dropDuplicates(["source_id"])
    return encode.refreshed(cache, reports(spark, folder)).select("source_id")


@query()
def archetype_density(spark: SparkSession, folder: str) -> DataFrame:
    """Archetypes by hierarchical density, fitted on a bounded sample of the vectors, with a label for each."""
    return density.clustered(table(spark, folder, "nuforc_embeddings"), min_size=20)


#: Registered with the others.
QUERIES: dict = {}
SQL: dict[str, str] = {}
