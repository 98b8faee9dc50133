"""Commit counts of a stream of commits: windowed, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_commits(commits: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Commits of each file in each window; works on a static table as well. commits: file_path, ts."""
    counted = commits.withWatermark("ts", late).groupBy(F.window("ts", window), "file_path").agg(F.count("*").alias("commits"))
    return counted.select(F.col("window.start").alias("window_start"), "file_path", "commits")
