"""Views on a folding and on the tracks' categories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions import stats
from tagloom.functions.ranks import quantiles
from tagloom.operators import assign
from tagloom.sources.shared import stored


def example_tracks(labelled: DataFrame, n: int = 2, *, mixed_only: bool = False) -> DataFrame:
    """The n best tracks of each category, one per artist: by cat_prob, then popularity, then track.

    labelled: track, artist, cat, cat_prob, popularity. mixed_only leaves out tracks that lie in one category alone."""
    rows = labelled.where("cat_prob < 1") if mixed_only else labelled
    # one row per category and artist by a plain aggregate, so a large category isn't sorted whole
    best = F.min(F.struct((-assign.tied("cat_prob")).alias("a"), (-F.col("popularity")).alias("b"), "track", "cat_prob", "popularity")).alias("x")
    per_artist = rows.groupBy("cat", "artist").agg(best)
    place = F.row_number().over(W.partitionBy("cat").orderBy("x.a", "x.b", "x.track"))
    return per_artist.withColumn("place", place).where(F.col("place") <= n).select("cat", "place", "x.track", "artist", "x.cat_prob", "x.popularity")


def solution(sizes: DataFrame, graph: DataFrame, above: float = 0.3) -> tuple[DataFrame, DataFrame]:
    """Categories that hold tracks, largest first, and the graph's edges from a threshold on."""
    return sizes.where("n > 0").orderBy(F.desc("n"), "cat"), graph.where(F.col("weight") >= above)


def gini_series(ginis: DataFrame) -> DataFrame:
    return ginis.select("k", "gini").where(~F.isnan("gini"))


def median_probability(best: DataFrame) -> DataFrame:
    """One row, median_max_prob, of the tracks' labels: exact, by distributed selection."""
    found = quantiles(best, "cat_prob", [0.5])
    return best.sparkSession.createDataFrame([(found[0],)], "median_max_prob double")


def posterior(q: DataFrame, cats: DataFrame) -> dict[str, DataFrame]:
    """Of the tracks' categories: histogram and median of the largest probability, correlation, label counts and their Gini."""
    best = stored(assign.labels(q), "labels")
    counts = assign.prevalences(best, cats)
    return {
        "histogram": stats.histogram(best, "cat_prob", 0.0, 0.01),
        "median": median_probability(best),
        "correlation": stats.spearman_block(q, q),
        "counts": counts,
        "gini": stats.gini(counts, "n"),
    }
