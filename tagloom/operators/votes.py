"""Normalised votes and what follows from them: marginals, co-occurrence, conditional probabilities, generality.

All of it stays long and sparse: (track, tag, p). Sums of p over the tracks replace means, since rows sum to one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.sources.sizes import dealt

FLOOR = 1e-12
#: Decimals at which generalities are compared.
DIGITS = 9


def normalized(long: DataFrame, partitions: int | None = None) -> DataFrame:
    """track, tag, p: each tag's share of a track's votes. Repeated (track, tag) rows are summed; tracks without votes go.

    One shuffle, by track; the sums by (track, tag) and the totals use it as it is. partitions: of that shuffle, if the session's
    own number would make tasks too large."""
    summed = dealt(long, partitions, "track").groupBy("track", "tag").agg(F.sum("votes").alias("votes"))
    total = F.sum("votes").over(W.partitionBy("track"))
    return summed.withColumn("total", total).where("total > 0").select("track", "tag", (F.col("votes") / F.col("total")).alias("p"))


def wide(p: DataFrame, tags: list[str]) -> DataFrame:
    """One column per tag, zero where a track lacks it."""
    return p.groupBy("track").agg(*(F.coalesce(F.sum(F.when(F.col("tag") == t, F.col("p"))), F.lit(0.0)).alias(t) for t in tags))


def marginals(p: DataFrame) -> DataFrame:
    """tag, n_tracks, total (sum of p) and marginal (its mean over all tracks)."""
    sums = p.groupBy("tag").agg(F.count("*").alias("n_tracks"), F.sum("p").alias("total"))
    tracks = F.round(F.sum("total").over(W.partitionBy()))  # one row per tag; rows of p sum to one
    return sums.withColumn("marginal", F.greatest(F.col("total") / tracks, F.lit(FLOOR)))


def by_track(p: DataFrame) -> DataFrame:
    """track, v: one row for each track, with its tags and shares (tag, p) by tag."""
    return p.groupBy("track").agg(F.sort_array(F.collect_list(F.struct("tag", "p"))).alias("v"))


def co_occurrence(p: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """a, b, s: sum over tracks of p_a * p_b, for a <> b. A track's tags are paired within its own row and summed before any shuffle.

    rows: by_track(p), where it is at hand."""
    track = by_track(p) if rows is None else rows
    first = track.select("v", F.posexplode("v").alias("i", "x"))
    pair = first.select("x", F.explode(F.slice("v", F.col("i") + 2, F.size("v"))).alias("y"))
    half = pair.groupBy(F.col("x.tag").alias("a"), F.col("y.tag").alias("b")).agg(F.sum(F.col("x.p") * F.col("y.p")).alias("s"))
    both = F.explode(F.array(F.struct("a", "b", "s"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "s")))
    return half.select(both.alias("x")).select("x.*")


def joint(p: DataFrame) -> DataFrame:
    """a, b, joint: mean of p_a * p_b."""
    tracks = p.agg(F.round(F.sum("p")).alias("n"))  # one row
    return co_occurrence(p).join(F.broadcast(tracks)).select("a", "b", (F.col("s") / F.col("n")).alias("joint"))


def conditional(p: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """a, b, w: P(b given a). rows: by_track(p), where it is at hand."""
    total = marginals(p).select(F.col("tag").alias("a"), "total")
    return co_occurrence(p, rows).join(total, "a").select("a", "b", (F.col("s") / F.col("total")).alias("w"))


def generality(p: DataFrame, w: DataFrame | None = None) -> DataFrame:
    """tag, generality: sum over a of P(tag given a); 0 for tags that are always alone."""
    w = conditional(p) if w is None else w
    sums = w.groupBy(F.col("b").alias("tag")).agg(F.sum("w").alias("g"))
    return p.select("tag").distinct().join(sums, "tag", "left").select("tag", F.coalesce("g", F.lit(0.0)).alias("generality"))


def most_general(g: DataFrame, n: int = 20) -> DataFrame:
    return g.orderBy(F.desc("generality"), "tag").limit(n)
