"""Bursts over a stream of dated reports: counts per week and key, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def weekly_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", late: str = "7 days") -> DataFrame:
    """(key, week_start, week_end, reports): Monday-to-Sunday weeks in UTC (the session's zone); state is kept per open week only, rows later than ``late`` are left out."""
    weeks = F.window(time, "7 days", "7 days", "4 days")  # the epoch was a Thursday
    counts = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).groupBy(weeks, key).agg(F.count("*").alias("reports"))
    return counts.select(key, F.col("window.start").cast("date").alias("week_start"), F.date_sub(F.col("window.end").cast("date"), 1).alias("week_end"), "reports")


def alerts(counts: DataFrame, baselines: DataFrame, key: str = "event_type", ratio: float = 3.0) -> DataFrame:
    """Weeks with at least ``ratio`` times the baseline (key, baseline_weekly); a stream-static join."""
    return counts.join(baselines, key).where(F.col("reports") >= ratio * F.col("baseline_weekly")).select(key, "week_start", "reports", F.round(F.col("reports") / F.col("baseline_weekly"), 1).alias("ratio"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is available, written to parquet, exactly once across restarts."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
