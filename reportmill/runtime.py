"""Session, table access, shared folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a lookup table may be broadcast; beyond, the join is left to the optimizer.
BROADCAST_ROWS = 200_000

_cleaned: set[str] = set()


def build_session(app: str = "reportmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC, AQE and Arrow; any setting can be overridden."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    for k, v in (base | {k.replace("__", "."): str(v) for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; columns are pruned by the plan that uses it."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is missing, one machine (a local master) gets a temporary folder and a cluster an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    if not root:
        root = getattr(shared_folder, "local", None) or "file://" + tempfile.mkdtemp(prefix="reportmill-")
        shared_folder.local = root
    folder = f"{root.rstrip('/')}/reportmill-{spark.sparkContext.applicationId}"
    if folder not in _cleaned:
        _cleaned.add(folder)
        atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:
        pass


def materialize(df: DataFrame, label: str = "step") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than cores dealt out to all of them, for work in Python; a larger scan is left as it is.

    Only the layout changes. Meant for scans: nothing runs to find their number of partitions.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with ``name``: its place in the order, from 0. Sorted in ranges; only a count for each range comes to the driver."""
    parts = df.orderBy(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at"))
    parts = materialize(parts, "numbered")
    begin, total = [], 0
    for r in sorted(parts.groupBy("_part").count().collect()):
        begin.append((r["_part"], total))
        total += r["count"]
    starts = df.sparkSession.createDataFrame(begin, "_part int, _begin long")
    return parts.join(F.broadcast(starts), "_part").withColumn(name, F.col("_begin") + F.col("_at")).drop("_part", "_at", "_begin")


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else unchanged (a shuffled join results)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
