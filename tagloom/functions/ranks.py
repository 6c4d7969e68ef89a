"""Places, running sums and exact quantiles of whole columns, without a task that sees them all."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.sources.shared import stored

#: Places whose sums are formed in one window.
BLOCK = 65_536
#: Different values that are fetched at the end of a selection, and the relative accuracy of the sketches that narrow it.
FEW, ACCURACY = 4_096, 1_000


def placed(rows: DataFrame, order: list[Column | str], name: str = "place") -> DataFrame:
    """rows with their places in an order, from 1: a place in its sorted partition after the counts of the partitions before.
    Equal rows are dealt out over partitions by a running number, in any order."""
    ranged = rows.withColumn("__same", F.monotonically_increasing_id()).repartitionByRange(*order, "__same").sortWithinPartitions(*order, "__same").drop("__same")
    kept = stored(ranged.withColumn("__id", F.monotonically_increasing_id()), "placed")
    part = F.shiftright("__id", 33)
    counts = kept.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))  # one row a partition
    before = counts.select("__part", (F.sum("__n").over(W.orderBy("__part")) - F.col("__n")).alias("__before"))
    at = F.col("__before") + F.col("__id") - F.shiftleft(part, 33) + 1
    return kept.withColumn("__part", part).join(F.broadcast(before), "__part").withColumn(name, at).drop("__part", "__id", "__before")


def sums_before(rows: DataFrame, place: str, value: str, name: str = "before") -> DataFrame:
    """rows with the sum of value over lesser places, in two levels: over blocks of BLOCK places, and within each."""
    block = F.floor(F.col(place) / BLOCK)
    blocks = rows.groupBy(block.alias("__block")).agg(F.sum(value).alias("__here"))
    ahead = blocks.select("__block", (F.sum("__here").over(W.orderBy("__block")) - F.col("__here")).alias("__ahead"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("__block").orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("__block", block).withColumn("__inside", inside).join(ahead, "__block").withColumn(name, F.col("__ahead") + F.col("__inside")).drop("__block", "__inside", "__ahead")


def _at_ranks(rows: DataFrame, value: str, ranks: list[int], n: int) -> dict[int, float]:
    """The values at places (from 0) of the n values that aren't null."""
    found: dict[int, float] = {}
    todo = [(sorted(set(ranks)), 0, n, None, None)]  # ranks, values before the range, values in it, its bounds
    while todo:
        wanted, before, here, low, high = todo.pop()
        inside = rows if low is None else rows.where(F.col(value).between(low, high))
        few = inside.groupBy(value).agg(F.count("*").alias("n")).orderBy(value).limit(FEW + 1)
        if here <= FEW or (low is not None and low == high) or few.count() <= FEW:
            at = before
            for r in few.collect():
                found |= {k: r[0] for k in wanted if at <= k < at + r.n}
                at += r.n
            continue
        # around each rank, bounds that a mergeable sketch promises to hold it, then exact counts of what lies below and within
        spans = []
        for k in wanted:
            q, slack = (k - before) / max(here - 1, 1), 2 / ACCURACY
            spans.append((max(0.0, q - slack), min(1.0, q + slack)))
        asked = sorted({x for s in spans for x in s})
        bounds = dict(zip(asked, inside.agg(F.percentile_approx(value, asked, ACCURACY)).first()[0], strict=True))
        for k, (a, b) in zip(wanted, spans, strict=True):
            lo, hi = bounds[a], bounds[b]
            below, within = inside.agg(F.count_if(F.col(value) < lo), F.count_if(F.col(value).between(lo, hi))).first()
            if not before + below <= k < before + below + within or (within == here and lo < hi):
                lo, hi, below, within = _halved(inside, value, k - before)
            todo.append(([k], before + below, within, lo, hi))
    return found


def _halved(rows: DataFrame, value: str, rank: int) -> tuple[float, float, int, int]:
    """The half of the values' range, cut at their approximate middle, that holds a rank: what sketches can't narrow still ends."""
    least, most, cut = rows.agg(F.min(value), F.max(value), F.percentile_approx(value, 0.5, ACCURACY)).first()
    low, at, n = rows.agg(F.count_if(F.col(value) < cut), F.count_if(F.col(value) <= cut), F.count("*")).first()
    if rank < low:
        below = rows.where(F.col(value) < cut).agg(F.max(value)).first()[0]
        return least, below, 0, low
    if rank < at:
        return cut, cut, low, at - low
    above = rows.where(F.col(value) > cut).agg(F.min(value)).first()[0]
    return above, most, at, n - at


def quantiles(rows: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact quantiles, between neighbours by their distance; null for no values. Nulls don't count.

    Selection by counts: a mergeable sketch bounds the ranks asked for, what lies below and within is counted exactly, and the range within
    is narrowed again until it holds FEW different values, which alone are fetched."""
    some = rows.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias(value))
    n = some.count()
    if not n:
        return [None] * len(shares)
    at = [q * (n - 1) for q in shares]
    found = _at_ranks(some, value, [f(x) for x in at for f in (math.floor, math.ceil)], n)
    ends = [(found[math.floor(x)], found[math.ceil(x)], x - math.floor(x)) for x in at]
    return [lo if lo == hi else (1 - t) * lo + t * hi for lo, hi, t in ends]
