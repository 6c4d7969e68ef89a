"""Vote totals over a stream of (ts, track, tag_name, tag_count) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_votes(stream: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """start, tag_name, votes, n per tumbling window; rows later than `late` are left out. Works on a batch alike."""
    seen = stream.withWatermark("ts", late)
    sums = seen.groupBy(F.window("ts", window), "tag_name").agg(F.sum("tag_count").alias("votes"), F.count("*").alias("n"))
    return sums.select(F.col("window.start").alias("start"), "tag_name", "votes", "n")
