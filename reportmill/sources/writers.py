"""Writers. A table is never written to the path it is read from."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Overwrites the path; an error if ``df`` reads from it, for the rows would be gone before they are read."""
    target = path.split("://")[-1].removeprefix("file:").rstrip("/")
    if any(unquote(f).split("://")[-1].removeprefix("file:").startswith(target + "/") for f in df.inputFiles()):
        raise ValueError(f"{path} is read and written at once; write to another path")
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    """One CSV with a header, for small reports."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def upserted(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``old`` with the rows of ``new`` in place of those with the same key; of several new rows the last by ``order``."""
    if order:
        w = Window.partitionBy(key).orderBy(F.desc(order))
        new = new.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


#: Bytes up to which a file is hashed as one value where it is read; larger ones are hashed as a stream by the driver, in constant memory.
ONE_VALUE = 1 << 28


def provenance(spark: SparkSession, path: str, rows: DataFrame | None = None) -> DataFrame:
    """(path, bytes, sha256, n_rows, schema, acquired_at) of every file under a path; rows and schema are those of ``rows``, what the files were read as."""
    files = spark.read.format("binaryFile").load(path)
    hashed = files.where(F.col("length") <= ONE_VALUE).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    large = []
    for r in files.where(F.col("length") > ONE_VALUE).select("path", "length").collect():
        p = spark._jvm.org.apache.hadoop.fs.Path(r.path)
        stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
        large.append((r.path, r.length, spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)))
        stream.close()
    every = hashed.union(spark.createDataFrame(large, "path string, bytes long, sha256 string")) if large else hashed
    count, schema = (rows.count(), rows.schema.simpleString()) if rows is not None else (None, None)
    return every.withColumns({"n_rows": F.lit(count).cast("long"), "schema": F.lit(schema).cast("string"), "acquired_at": F.current_timestamp()})


def drop_report(raw: DataFrame, dropped: DataFrame) -> DataFrame:
    """(reason, n_rows, pct): why rows were dropped, as shares of all raw rows."""
    total = raw.agg(F.count("*").alias("total"))
    n = dropped.groupBy("reason").agg(F.count("*").alias("n_rows"))
    return n.crossJoin(F.broadcast(total)).select("reason", "n_rows", F.round(F.col("n_rows") * 100 / F.col("total"), 2).alias("pct"))  # total is one row
