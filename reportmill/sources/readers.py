"""Readers of raw extracts. Schemas are given, never inferred, so no file is read twice."""

from __future__ import annotations

import time
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


_VIEWS: dict[tuple[str, str], tuple[DataFrame, float]] = {}


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def text_schema(columns: list[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def csv_headers(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8") -> list[str]:
    """The header names as written, from the first line only."""
    return spark.read.options(header=True, sep=sep, encoding=encoding, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, enforceSchema=False).csv(path).limit(0).columns


def csv(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with a header, all text, quoted line breaks kept; each file as UTF-8, or as Latin-1 if any of its lines is no UTF-8."""
    latin, utf8 = encodings(spark, path)
    parts = []
    for encoding, files in (("UTF-8", utf8), ("ISO-8859-1", latin)):
        if files:
            source = path if not (latin and utf8) else files
            names = csv_headers(spark, source, sep, encoding)
            parts.append(spark.read.schema(text_schema(names)).options(header=True, sep=sep, multiLine=True, escape='"', encoding=encoding).csv(source))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts) if parts else spark.createDataFrame([], "value string").limit(0)


def encodings(spark: SparkSession, path: str) -> tuple[list[str], list[str]]:
    """(files with a line that is no UTF-8, the other files). Spark replaces bad bytes silently, so every line of every file is tested where it is read.

    Only one row per file comes to the driver, which lists the files anyway.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.expr("is_valid_utf8(value)").alias("fine"))
    rows = lines.groupBy("file").agg(F.bool_and("fine").alias("fine")).orderBy("file").collect()
    return [unquote(r.file) for r in rows if not r.fine], [unquote(r.file) for r in rows if r.fine]


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of a file of JSON lines; blank lines are neither."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    good = F.expr("try_parse_json(value) IS NOT NULL AND value LIKE '%{%'")
    return lines.where(good).select(F.from_json("value", schema).alias("r")).select("r.*"), lines.where(~good)


def gazetteer_tsv(spark: SparkSession, path: str) -> DataFrame:
    """USPS, NAME, INTPTLAT, INTPTLONG of a tab-separated gazetteer whose headers may have blanks, coordinates as numbers."""
    raw = csv(spark, path, "\t")
    raw = raw.toDF(*[c.strip() for c in raw.columns])
    return raw.select(F.col("USPS").alias("usps"), F.col("NAME").alias("name"), F.trim("INTPTLAT").try_cast("double").alias("intptlat"), F.trim("INTPTLONG").try_cast("double").alias("intptlong"))


def parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A parquet table; with a schema, an absent one reads as empty."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.parquet(path)


def reports(spark: SparkSession, path: str) -> DataFrame:
    """Raw reports by extension: JSON lines or CSV."""
    if path.endswith((".jsonl", ".ndjson")):
        names = "sighting_id long, occurred string, reported string, posted string, location string, shape string, duration string, characteristics string, narrative string, scraped_at string"
        return jsonl(spark, path, names)[0]
    return csv(spark, path)


def of_type(records: DataFrame, kinds: tuple[str, ...] = ("PDF", "VID", "IMG"), column: str = "Type") -> DataFrame:
    return records.where(F.trim(column).isin(list(kinds)))


def pending(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to do: ids not among the done ones."""
    return wanted.join(done.select(key).distinct(), key, "left_anti")


def work_list(ids: DataFrame, key: str, start: int | None = None, most: int | None = None) -> DataFrame:
    """Ids in order from ``start`` on, at most ``most`` of them: a portion of the work to do."""
    out = ids.where(F.col(key) >= start) if start is not None else ids
    out = out.select(key).distinct().orderBy(key)
    return out.limit(most) if most is not None else out


def required(spark: SparkSession, path: str) -> str:
    """The path, or an error that names it if nothing is there."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path} is missing; run the step that writes it first")
    return path


def nonempty(df: DataFrame, what: str) -> DataFrame:
    """``df``, or an error if no row is left of it."""
    if df.isEmpty():
        raise ValueError(f"no row left after {what}")
    return df


def cached_view(df: DataFrame, name: str, seconds: float = 3600.0) -> DataFrame:
    """``df`` cached under a view name; asked for again within ``seconds`` the cached rows come back, later they are read anew."""
    spark = df.sparkSession
    kept = _VIEWS.get((spark.sparkContext.applicationId, name))
    if kept and time.monotonic() - kept[1] < seconds:
        return kept[0]
    if kept:
        kept[0].unpersist()
    cached = df.cache()
    cached.createOrReplaceTempView(name)
    _VIEWS[spark.sparkContext.applicationId, name] = cached, time.monotonic()
    return cached
