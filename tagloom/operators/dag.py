"""The weighted graph from specific to general tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.operators import votes


def edges(p: DataFrame, w: DataFrame | None = None) -> DataFrame:
    """from_tag, to_tag, weight: P(to given from) wherever `to` is strictly more general. Ties give no edge, so there is no cycle.

    w: the conditional probabilities, where they are at hand."""
    w = votes.conditional(p) if w is None else w
    g = votes.generality(p, w).select("tag", F.round("generality", votes.DIGITS).alias("g"))
    low, high = g.toDF("a", "ga"), g.toDF("b", "gb")
    return w.join(low, "a").join(high, "b").where("ga < gb and w > 0").select(F.col("a").alias("from_tag"), F.col("b").alias("to_tag"), F.col("w").alias("weight"))


def roots(tags: DataFrame, graph: DataFrame) -> DataFrame:
    """Tags without an outgoing edge, isolated ones included."""
    return tags.join(graph.select(F.col("from_tag").alias("tag")).distinct(), "tag", "left_anti")


def parent_weights(graph: DataFrame) -> DataFrame:
    """child, parent, w: edge weights as shares of the child's. Roots have no row."""
    share = F.col("weight") / F.sum("weight").over(W.partitionBy("from_tag"))
    return graph.select(F.col("from_tag").alias("child"), F.col("to_tag").alias("parent"), share.alias("w"))


def strong_edges(graph: DataFrame, above: float = 0.1) -> DataFrame:
    """Edges over a threshold; undefined weights go."""
    return graph.where(~F.isnan("weight") & (F.col("weight") > above))
