"""Categories of tracks: probabilities, labels and sizes. The two tie rules differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Decimals at which probabilities tie; sums of doubles depend on their order beyond that.
DIGITS = 12


def tied(p: str) -> Column:
    return F.round(p, DIGITS)


def probabilities(p: DataFrame, mapping: DataFrame) -> DataFrame:
    """track, cat, p: each tag's share is passed on by mapping(tag, cat, w)."""
    return p.join(mapping, "tag").groupBy("track", "cat").agg(F.sum(F.col("p") * F.col("w")).alias("p"))


def labels(q: DataFrame, cat: str = "cat") -> DataFrame:
    """track, cat, cat_prob: the most probable category, of ties the first by name."""
    least = F.min(F.struct((-tied("p")).alias("less"), F.col(cat).alias("cat"), F.col("p").alias("cat_prob"))).alias("x")
    return q.groupBy("track").agg(least).select("track", "x.cat", "x.cat_prob")


def rarity(p: DataFrame) -> DataFrame:
    """tag, n_tracks and its average rank (1 is the rarest)."""
    n = p.where("p > 0").groupBy("tag").agg(F.count("*").alias("n_tracks"))
    rank = F.rank().over(W.orderBy("n_tracks")) + (F.count("*").over(W.partitionBy("n_tracks")) - 1) / 2  # one row per tag
    return n.withColumn("rank", rank.cast("double"))


def hard_sizes(q: DataFrame, rarities: DataFrame, cats: DataFrame, cat: str = "cat") -> DataFrame:
    """cat, n: tracks whose most probable category it is, of ties the rarest as a tag, then the first by name. Zero if none."""
    ranked = q.join(F.broadcast(rarities.select(F.col("tag").alias(cat), "n_tracks")), cat)  # one row per tag
    least = F.min(F.struct((-tied("p")).alias("less"), "n_tracks", F.col(cat).alias("cat"))).alias("x")
    counts = ranked.groupBy("track").agg(least).groupBy("x.cat").agg(F.count("*").alias("n"))
    return cats.join(counts, "cat", "left").select("cat", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def prevalences(labelled: DataFrame, cats: DataFrame) -> DataFrame:
    """cat, n, share of all labels, zero for categories without any."""
    counts = labelled.groupBy("cat").agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    filled = cats.join(counts, "cat", "left").select("cat", n.cast("long").alias("n"))
    return filled.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(W.partitionBy())))


def wide_map(q: DataFrame, cats: list[str]) -> DataFrame:
    """One row per track: a column per category, cat and cat_prob."""
    columns = q.groupBy("track").pivot("cat", cats).agg(F.sum("p")).na.fill(0.0, cats)
    return columns.join(labels(q), "track")


def add_to_long(long: DataFrame, labelled: DataFrame) -> DataFrame:
    return long.join(labelled, "track", "left")
