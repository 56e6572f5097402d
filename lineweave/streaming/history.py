"""Churn over a stream of commits: an extension, by event time with a watermark for late commits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def churn_windows(commits: DataFrame, length: str = "7 days", late: str = "1 day") -> DataFrame:
    """(window_start, file, commits) in tumbling windows; commits: a stream or table of (commit_id, file, ts)."""
    rows = commits.withWatermark("ts", late)
    out = rows.groupBy(F.window("ts", length).alias("w"), "file").agg(F.approx_count_distinct("commit_id").alias("commits"))
    return out.select(F.col("w.start").alias("window_start"), "file", "commits")
