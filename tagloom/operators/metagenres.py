"""Tracks under a mapping from tags to metagenres, in the wide form: shares p_, votes n_, maxima and the label."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sanitized(name: str) -> str:
    """A name as part of a column's name."""
    return re.sub("[ &-]", "", name)


def prevalences(long: DataFrame) -> DataFrame:
    """track, metagenre, n, p: votes and their share within the track. long: track, metagenre, votes; partitions by track are kept."""
    n = long.where("track is not null").groupBy("track", "metagenre").agg(F.sum("votes").alias("n"))
    return n.select("track", "metagenre", "n", (F.col("n") / F.sum("n").over(W.partitionBy("track"))).alias("p"))


def _sized(shares: DataFrame, how: str) -> DataFrame:
    """shares with the votes of each metagenre in all; a row per metagenre is broadcast."""
    size = shares.groupBy("metagenre").agg(F.sum("n").alias("size"))
    return shares.join(F.broadcast(size), "metagenre", how)


def _best() -> Column:
    """The least of these is the track's class."""
    return F.struct((-F.round("p", 12)).alias("less"), "size", "metagenre")


def hard_classes(shares: DataFrame) -> DataFrame:
    """track, metagenre: the largest share, of ties the metagenre with fewer votes in all, then the first by name."""
    return _sized(shares, "inner").groupBy("track").agg(F.min(_best()).alias("x")).select("track", "x.metagenre")


def mapped(long: DataFrame, mapping: DataFrame, names: list[str]) -> DataFrame:
    """One row per track: p_ and n_ of each metagenre (zero if unmentioned), n_max, p_max, metagenre.

    The mapping has a row per tag and is broadcast; the rest is one aggregate per track."""
    shares = prevalences(long.join(F.broadcast(mapping), "tag"))
    of = lambda kind, m: F.coalesce(F.sum(F.when(F.col("metagenre") == m, F.col(kind))), F.lit(0.0)).alias(f"{kind}_{sanitized(m)}")
    best = F.min(F.when(F.col("metagenre").isNotNull(), _best())).alias("x")
    each = _sized(shares, "left").groupBy("track").agg(*(of(kind, m) for kind in ("p", "n") for m in names), F.max("n").alias("n_max"), F.max("p").alias("p_max"), best)
    return each.where("x is not null").withColumn("x", F.col("x.metagenre")).withColumnRenamed("x", "metagenre")
