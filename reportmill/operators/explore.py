"""What an explorer asks: filters, counts, ranks, samples, a keyword router."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reportmill.runtime import numbered


def filtered(reports: DataFrame, first: int, last: int, states: list[str] = (), shapes: list[str] = (), words: str = "") -> DataFrame:
    """Reports of the years, states and shapes (none: all) whose narrative holds the words, whatever their case."""
    out = reports.where(F.col("event_year").between(first, last))
    out = out.where(F.col("state").isin(list(states))) if states else out
    out = out.where(F.col("shape_norm").isin(list(shapes))) if shapes else out
    return out.where(F.contains(F.lower("narrative"), F.lower(F.lit(words)))) if words else out


def searched(reports: DataFrame, words: str, columns: list[str]) -> DataFrame:
    """Reports any of whose columns holds the words, whatever their case."""
    hits = [F.coalesce(F.contains(F.lower(c), F.lit(words.lower())), F.lit(False)) for c in columns]
    return reports.where(reduce(lambda a, b: a | b, hits))


def counts(reports: DataFrame, key: str) -> DataFrame:
    """(key, n_reports) without nulls."""
    return reports.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n_reports"))


def top(reports: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent values (ties: alphabetical), empty ones aside, with their share."""
    all_ = counts(reports.where(F.col(key) != ""), key)
    ranked = all_.orderBy(F.desc("n_reports"), key).limit(n)
    total = all_.agg(F.sum("n_reports").alias("total"))
    return ranked.crossJoin(F.broadcast(total)).select(key, "n_reports", F.round(F.col("n_reports") * 100 / F.col("total"), 1).alias("pct"))  # total is one row


def ranked(reports: DataFrame, key: str) -> DataFrame:
    """Every value with its rank by count (ties: alphabetical)."""
    return counts(reports.where(F.col(key) != ""), key).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_reports"), key)))


def metrics(reports: DataFrame) -> DataFrame:
    return reports.agg(
        F.count("*").alias("n_reports"), F.countDistinct(F.when(F.col("state") != "", F.col("state"))).alias("n_states"), F.min("event_year").alias("first_year"), F.max("event_year").alias("last_year"),
        F.countDistinct(F.when(F.col("shape_norm") != "", F.col("shape_norm"))).alias("n_shapes"), F.median("narrative_chars").cast("double").alias("median_chars"),
    )


def sampled(reports: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Exactly n rows (or all), the same for the same seed whatever the partitioning and engine."""
    return reports.orderBy(F.md5(F.concat("source_id", F.lit(f":{seed}"))), "source_id").limit(n)


def exactly_placed(reports: DataFrame) -> DataFrame:
    """Reports whose place was found by its own name."""
    return reports.where("geocode_method = 'exact' AND latitude IS NOT NULL AND longitude IS NOT NULL")


def listed(reports: DataFrame, by: str) -> DataFrame:
    """``reports`` with their place, from 0, in the order of a column (nulls last; ties: smaller id). Sorted in ranges, whatever their number."""
    return numbered(reports, [F.col(by).asc_nulls_last(), F.col("source_id")], "place")


def bubbles(counts_: DataFrame, value: str, least: float = 6.0, span: float = 26.0) -> DataFrame:
    """``counts_`` with the radius of a bubble whose area follows the value."""
    return counts_.withColumn("radius", F.round(least + F.sqrt(F.col(value) / F.max(value).over(Window.partitionBy())) * span, 4))


def narratives_of(labels: DataFrame, reports: DataFrame, group: str, most: int = 3) -> DataFrame:
    """(group, place, source_id, narrative): the first reports of each group by id, empty narratives aside."""
    w = Window.partitionBy(group).orderBy("source_id")
    own = labels.join(reports.where("narrative <> ''").select("source_id", "narrative"), "source_id")
    return own.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select(group, "place", "source_id", "narrative")


def anomaly(reports: DataFrame, population: DataFrame) -> DataFrame:
    """(state, n_reports, anomaly): a state's share of reports over its share of ``population`` (state, weight)."""
    n = counts(reports.where("state <> ''"), "state").join(population, "state")
    w = Window.partitionBy()
    return n.select("state", "n_reports", F.round((F.col("n_reports") / F.sum("n_reports").over(w)) / (F.col("weight") / F.sum("weight").over(w)), 4).alias("anomaly"))


def matches(frames: dict[str, tuple[DataFrame, list[str]]], words: str) -> DataFrame:
    """(collection, n_matches): rows of each collection with the words in any of its columns."""
    spark = next(iter(frames.values()))[0].sparkSession
    parts = [searched(df, words, cols).agg(F.count("*").alias("n_matches")).select(F.lit(name).alias("collection"), "n_matches") for name, (df, cols) in frames.items()]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "collection string, n_matches long")


def routed(keywords: list[str], stages: list[tuple[str, DataFrame, bool]]) -> DataFrame:
    """(keyword, kind, label): for each keyword the first stage that knows it.

    ``stages``: (kind, frame of (label, term), whether the term must be the keyword or may hold it). Case and outer blanks do not
    count; an empty keyword is known to none. Within a stage the alphabetically first label counts; no match gives no row.
    """
    spark = stages[0][1].sparkSession
    asked = spark.createDataFrame([(k, k.strip().lower()) for k in keywords if k.strip()], "keyword string, k string")
    parts = []
    for place, (kind, df, whole) in enumerate(stages):
        t = df.select(F.col("label").cast("string").alias("label"), F.lower(F.col("term").cast("string")).alias("t"))
        hit = t.join(F.broadcast(asked), F.col("t") == F.col("k") if whole else F.contains("t", "k"))
        parts.append(hit.groupBy("keyword").agg(F.min("label").alias("label")).select("keyword", F.lit(place).alias("place"), F.lit(kind).alias("kind"), "label"))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("keyword").agg(F.min(F.struct("place", "kind", "label")).alias("m")).select("keyword", "m.kind", "m.label")


def router_stages(states: DataFrame, shapes: DataFrame, archetypes: DataFrame, years: DataFrame, events_: DataFrame, terms: DataFrame, flaps_: DataFrame, first: int = 1905, last: int = 2023) -> list:
    """The stages of the keyword router in their order; each frame is (label, term), years (label, term) with the year as term."""
    year = years.where(F.col("term").cast("int").between(first, last))
    return [
        ("state", states, True), ("shape", shapes, True), ("archetype", archetypes.where("exact"), True), ("archetype", archetypes.where("NOT exact"), False), ("year", year, True),
        ("event", events_, False), ("term", terms, True), ("state", states, False), ("event", flaps_, False), ("term", terms, False),
    ]


def context(route: DataFrame, kind: str, frame: DataFrame, on: str) -> DataFrame:
    """The rows of a frame that belong to the keywords routed to a kind: where the column is, or as an array or text holds, the label."""
    r = F.broadcast(route.where(F.col("kind") == kind).select("keyword", "label"))
    array = frame.schema[on].dataType.typeName() == "array"
    held = F.expr(f"array_contains(`{on}`, label)") if array else F.col(on).cast("string") == F.col("label")
    return frame.join(r, held)


def _leaf(value: object) -> str:
    """A JSON value as JavaScript writes it as text."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if value is None:
        return "null"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def leaves(value: object, path: str = "") -> list[tuple[str, str]]:
    """(path, text) of every leaf of a JSON value in document order: members after dots, items by their number in brackets; a bare value has none."""
    out: list[tuple[str, str]] = []
    stack: list[tuple[str, object]] = [(path, value)]
    while stack:
        at, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{at}.{k}" if at else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(f"{at}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif at != path:
            out.append((at, _leaf(v)))
    return out


def flattened(df: DataFrame, keys: list[str], json_column: str, most: int = 40) -> DataFrame:
    """(keys, path, value): the first ``most`` leaves of each JSON value, however deep; null and malformed values have none.

    Depth is data, which no built-in follows, so values go through Python in Arrow batches.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, path, value = [], [], []
            for k, text in enumerate(b.column(len(keys)).to_pylist()):
                try:
                    found = leaves(json.loads(text)) if text else []
                except ValueError:
                    found = []
                for p, v in found[:most]:
                    row.append(k)
                    path.append(p)
                    value.append(v)
            take = pa.array(row, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(i).take(take) for i in range(len(keys))], pa.array(path, pa.string()), pa.array(value, pa.string())], [*keys, "path", "value"])

    return df.select(*keys, json_column).mapInArrow(flatten, f"{kinds}, path string, value string")


#: Name, first and last year of the eras a year may belong to; the first that holds it counts.
ERAS = (("Saucer era", 1947, 1965), ("Abduction era", 1965, 1985), ("Triangle era", 1982, 2000), ("Orange-orb era", 2005, 2020), ("Post-disclosure", 2017, 2024))


def era(year: Column) -> Column:
    """The first era that holds a year, else null."""
    return reduce(lambda rest, e: F.when(year.between(e[1], e[2]), e[0]).otherwise(rest), reversed(ERAS), F.lit(None).cast("string"))


def leading_number(text: Column) -> Column:
    """The whole number a text begins with, as in 2014x, else null."""
    return F.regexp_extract(text, r"^\s*([+-]?\d+)", 1).try_cast("int")


def first_and_peak(rated: DataFrame) -> DataFrame:
    """(term, first_bin, peak_bin, lowest, highest): first bin with a rate above zero, bin of the highest rate (ties: earliest), range."""
    return rated.groupBy("term").agg(
        F.min(F.when(F.col("rate_per_1k") > 0, F.col("time_bin"))).alias("first_bin"), F.max_by("time_bin", F.struct("rate_per_1k", -F.col("time_bin"))).alias("peak_bin"),
        F.min("rate_per_1k").alias("lowest"), F.max("rate_per_1k").alias("highest"),
    )


def scaled(counts_: DataFrame, value: str) -> DataFrame:
    """``counts_`` with the value as a share of the largest, at most 1."""
    return counts_.withColumn("scaled", F.round(F.least(F.col(value) / F.max(value).over(Window.partitionBy()), F.lit(1.0)), 4))


def yearly(reports: DataFrame, marks: DataFrame, least: int = 0) -> DataFrame:
    """(event_year, n_reports, n_marks): years with the number of marks (event_year) that fall in each, zero where none does."""
    m = marks.groupBy("event_year").agg(F.count("*").alias("n_marks"))
    return counts(reports, "event_year").where(F.col("n_reports") >= least).join(m, "event_year", "left").na.fill(0, ["n_marks"])


def detections(matrix: DataFrame) -> DataFrame:
    """(kind, n_events, each method's hits): totals per kind of event and, with a null kind, over all."""
    return matrix.rollup("kind").agg(
        F.count("*").alias("n_events"), F.count_if(F.col("cluster_count") > 0).alias("by_cluster"), F.count_if(F.col("flap_count") > 0).alias("by_flap"),
        F.count_if("sig_found").alias("by_phrase"), F.count_if("shape_matches").alias("by_shape"),
    )
