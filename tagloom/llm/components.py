"""Connected components by alternating star contractions, on tables only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm.common import discard, stored


#: Edges that one task of a round takes.
ROWS_PER_TASK = 250_000


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours move to its least neighbour (or itself)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node's lesser neighbours, and the node, move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("m").alias("a"), "b").where("a <> b")
    return moved.unionByName(least.select(F.col("m").alias("a"), F.col("a").alias("b"))).distinct()


def _narrow(edges: DataFrame, rows: int) -> DataFrame:
    """As many tasks as the rows need: a small remainder isn't spread over thousands of files."""
    return edges.coalesce(max(1, -(-rows // ROWS_PER_TASK)))


def _state(edges: DataFrame) -> tuple[int, int]:
    """Number of edges and a sum over them that changes with any of them."""
    n, total = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return n, int(total or 0)


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of the component, for every node of edges(a, b); a < b need not hold.

    Rounds go on until a round changes no edge, which is when they are stars: a logarithmic number of them. Each one is a stored
    table, so a lost executor costs one round. A hub's edges are joined by its id; Spark splits that partition if it is large.
    """
    now = stored(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    while before[0]:
        last, now = now, stored(_narrow(_small_star(_large_star(now)), before[0]), "edges")
        discard(last)
        after = _state(now)
        if after == before:
            break
        before = after
    return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
