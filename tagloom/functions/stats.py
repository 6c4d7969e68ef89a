"""Statistics over long tables, and their small numeric helpers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.sources.shared import stored
from tagloom.sources.sizes import dealt, partitions_for


def gini_of(values: list[float]) -> float:
    """Unbiased Gini coefficient; not a number for fewer than two values or a zero sum."""
    x = sorted(values)
    n, total = len(x), sum(x)
    if n < 2 or total == 0:
        return math.nan
    return (2 * sum((i + 1) * v for i, v in enumerate(x)) / (n * total) - (n + 1) / n) * n / (n - 1)


def gini(rows: DataFrame, value: str) -> DataFrame:
    """One row, gini, of a small table (one row per category)."""
    place = F.row_number().over(W.orderBy(value))
    x = rows.select(F.col(value).cast("double").alias("x"), place.alias("i"))
    n, total = F.count("*"), F.sum("x")
    return x.agg((F.try_divide(2 * F.sum(F.col("i") * F.col("x")), n * total) - F.try_divide(n + 1, n)).alias("g"), n.alias("n")).select((F.col("g") * F.try_divide(F.col("n"), F.col("n") - 1)).alias("gini"))


def ranks_of_values(counts: DataFrame, keys: list[str], value: str, width: float = 1 / 256) -> DataFrame:
    """keys, value, n, rank: the average rank of each different value within keys, of counts(keys, value, n). Counts are summed up in
    two levels, over steps of `width` and within each, so no category's values meet in one task."""
    distinct = counts.withColumn("__step", F.floor(F.col(value) / width))
    steps = distinct.groupBy(*keys, "__step").agg(F.sum("n").alias("__of_step"))
    before = steps.select(*keys, "__step", (F.sum("__of_step").over(W.partitionBy(*keys).orderBy("__step")) - F.col("__of_step")).alias("__before"))
    upto = F.sum("n").over(W.partitionBy(*keys, "__step").orderBy(value))
    ranked = distinct.withColumn("__upto", upto).join(before, [*keys, "__step"])
    return ranked.select(*keys, value, "n", (F.col("__before") + F.col("__upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def average_ranks(long: DataFrame, keys: list[str], value: str, width: float = 1 / 256) -> DataFrame:
    """long with `rank`, the average rank of value within keys. Ranks come from counts of different values, so ties cost nothing."""
    counts = long.groupBy(*keys, value).agg(F.count("*").alias("n"))
    return long.join(ranks_of_values(counts, keys, value, width).drop("n"), [*keys, value])


#: Different values of all categories of one side whose ranks are broadcast; more are met by shuffled joins.
MOST_VALUES = 1_000_000


def side_by_side(first: DataFrame, second: DataFrame) -> DataFrame:
    """track, a, b of the tracks of both long tables: their (cat, p) as arrays. Stored, so that what follows shuffles no rows.

    Tables in equal partitions by track are met as they are."""
    lists = lambda df, to: df.groupBy("track").agg(F.collect_list(F.struct("cat", "p")).alias(to))
    return stored(lists(first, "a").join(lists(second, "b"), "track"), "sides")


def spearman_block(first: DataFrame, second: DataFrame) -> DataFrame:
    """a, b, corr over first(track, cat, p) x second(track, cat, p), with zeros where a track lacks a category.

    Only tracks in both count. Ranks are of the dense columns: absent values share the average rank of zero, and
    the correlation follows from sums over what is there, so nothing is filled in."""
    return spearman_cells(side_by_side(first, second))


def spearman_cells(sides: DataFrame) -> DataFrame:
    """spearman_block of side_by_side's table. The different values are counted and ranked first; few enough are broadcast, and a
    track's values meet their ranks, and each other, within its row."""
    n = sides.agg(F.count("*").alias("tracks"))  # one row
    entries = lambda name, *keep: sides.select(*keep, F.explode(name).alias("e")).where("e.p > 0")

    def ranked(name: str) -> tuple[DataFrame, int, int]:
        """name, p, n, r of the different values, how many these are and how many there are in all."""
        counts = stored(entries(name).groupBy(F.col("e.cat").alias(name), F.col("e.p").alias("p")).agg(F.count("*").alias("n")), "values")
        absent = counts.groupBy(name).agg(F.sum("n").alias("present")).join(F.broadcast(n)).select(name, (F.col("tracks") - F.col("present")).alias("absent"))
        # rank among all = zeros + rank among those present; less the rank of a zero, so that zeros weigh nothing
        r = F.col("rank") + F.col("absent") - (F.col("absent") + 1) / 2.0 * F.when(F.col("absent") > 0, 1).otherwise(0)
        ranks = ranks_of_values(counts, [name], "p").join(F.broadcast(absent), name).select(name, "p", "n", r.alias("r"))  # one row per category
        return stored(ranks, "ranks"), *counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()

    (a, values_a, rows_a), (b, values_b, rows_b) = ranked("a"), ranked("b")
    rank = lambda ranks, name: ranks.select(F.col(name).alias("cat"), "p", F.col("r").alias(f"r_{name}"))
    if max(values_a, values_b) <= MOST_VALUES:
        one = entries("a", "b").select("e.*", "b").join(F.broadcast(rank(a, "a")), ["cat", "p"]).select(F.col("cat").alias("a"), "r_a", F.explode("b").alias("e"))
        both = one.select("a", "r_a", "e.*").join(F.broadcast(rank(b, "b")), ["cat", "p"]).withColumnRenamed("cat", "b")
    else:
        parts = partitions_for(max(rows_a, rows_b))
        met = lambda ranks, name: dealt(dealt(entries(name, "track").select("track", "e.*"), parts, "cat", "p").join(rank(ranks, name), ["cat", "p"]).select("track", F.col("cat").alias(name), f"r_{name}"), parts, "track")
        both = met(a, "a").join(met(b, "b"), "track")
    cross = both.groupBy("a", "b").agg(F.sum(F.col("r_a") * F.col("r_b")).alias("x"))
    sums = lambda ranks, k: ranks.groupBy(k).agg(F.sum(F.col("n") * F.col("r")).alias(f"s_{k}"), F.sum(F.col("n") * F.col("r") * F.col("r")).alias(f"q_{k}"))
    cells = sums(a, "a").crossJoin(sums(b, "b")).join(F.broadcast(n)).join(cross, ["a", "b"], "left")  # one row per pair of categories
    t = F.col("tracks")
    cov = F.coalesce("x", F.lit(0.0)) - F.col("s_a") * F.col("s_b") / t
    var = (F.col("q_a") - F.col("s_a") * F.col("s_a") / t) * (F.col("q_b") - F.col("s_b") * F.col("s_b") / t)
    return cells.select("a", "b", F.try_divide(cov, F.sqrt(F.greatest(var, F.lit(0.0)))).alias("corr"))


def jensen_shannon(first: DataFrame, second: DataFrame, on: str = "cat", by: str = "tag") -> DataFrame:
    """by, jsd: divergence in bits of the two distributions over `on`, each normalised; null where either has no mass."""
    share = lambda df, to: df.select(by, on, (F.col("w") / F.sum("w").over(W.partitionBy(by))).alias(to))
    both = share(first.where("w > 0"), "x").join(share(second.where("w > 0"), "y"), [by, on], "full").na.fill(0.0, ["x", "y"])
    m = (F.col("x") + F.col("y")) / 2
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / m)).otherwise(0.0)
    sums = both.groupBy(by).agg(F.sum((part("x") + part("y")) / 2).alias("jsd"), F.sum("x").alias("mx"), F.sum("y").alias("my"))
    return sums.select(by, F.when((F.col("mx") > 0) & (F.col("my") > 0), F.col("jsd")).alias("jsd"))


def macro_f1(pairs: DataFrame) -> DataFrame:
    """One row, macro_f1, of pairs(truth, guess): mean over the classes that the truth holds."""
    counts = pairs.groupBy("truth", "guess").agg(F.count("*").alias("n"))
    hit = F.when(F.col("truth") == F.col("guess"), F.col("n")).otherwise(0)
    truth = counts.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("t"), F.sum(hit).alias("tp"))
    guess = counts.groupBy(F.col("guess").alias("c")).agg(F.sum("n").alias("g"))
    f1 = truth.join(guess, "c", "left").select((2.0 * F.col("tp") / (F.col("t") + F.coalesce("g", F.lit(0)))).alias("f"))
    return f1.agg(F.avg("f").alias("macro_f1"))


def t_statistic(rows: DataFrame, value: str) -> DataFrame:
    """One row: mean, t and df of the one-sample test against zero."""
    n, mean, sd = F.count(value), F.avg(value), F.stddev_samp(value)
    return rows.agg(mean.alias("mean"), F.try_divide(mean, sd / F.sqrt(n)).alias("t"), (n - 1).alias("df"))


def log_gamma(x: str) -> str:
    """SQL of the logarithm of the gamma function for x > 0: Stirling's series eight further, and the way back."""
    y = f"({x} + 8)"
    return f"(({y} - 0.5D) * ln({y}) - {y} + 0.918938533204672742D + 1 / (12 * {y}) - 1 / (360 * power({y}, 3)) + 1 / (1260 * power({y}, 5)) - 1 / (1680 * power({y}, 7)) - aggregate(sequence(0, 7), 0D, (s, k) -> s + ln({x} + k)))"


#: Terms of the continued fraction; it needs about the square root of the degrees of freedom.
TERMS = 400


def _fraction(a: str, b: str, x: str) -> str:
    """SQL of the incomplete beta function for x below (a + 1) / (a + b + 2): its continued fraction, term by term."""
    even = f"m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))"
    odd = f"-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))"
    step = lambda s, n: f"named_struct('c', 1 + {n} / {s}.c, 'd', 1 / (1 + {n} * {s}.d), 'h', {s}.h * (1 + {n} / {s}.c) / (1 + {n} * {s}.d))"
    both = f"transform(array({step('s', even)}), u -> {step('u', odd)})[0]"
    start = f"transform(array(1 / (1 - ({a} + {b}) * {x} / ({a} + 1))), z -> named_struct('c', 1D, 'd', z, 'h', z))[0]"
    tail = f"aggregate(sequence(1, {TERMS}), {start}, (s, k) -> transform(array(cast(k as double)), m -> {both})[0], s -> s.h)"
    return f"exp({log_gamma(f'({a} + {b})')} - {log_gamma(a)} - {log_gamma(b)} + {a} * ln({x}) + {b} * ln(1 - {x})) / {a} * {tail}"


def t_p_value(t: str, df: str) -> Column:
    """Two-sided p of Student's t, from the names of the columns: the incomplete beta function at df / (df + t * t); null without degrees of freedom."""
    x = f"({df} / ({df} + {t} * {t}))"
    near = f"{x} <= ({df} / 2D + 1) / ({df} / 2D + 2.5D)"
    p = f"CASE WHEN {t} = 0 THEN 1D WHEN {near} THEN {_fraction(f'({df} / 2D)', '0.5D', x)} ELSE 1 - {_fraction('0.5D', f'({df} / 2D)', f'({t} * {t} / ({df} + {t} * {t}))')} END"
    return F.expr(f"CASE WHEN {df} >= 1 AND {t} IS NOT NULL THEN {p} END")


def histogram(rows: DataFrame, value: str, lo: float, width: float) -> DataFrame:
    """bin, n: floor((x - lo) / width)."""
    return rows.where(F.col(value).isNotNull()).groupBy(F.floor((F.col(value) - lo) / width).alias("bin")).agg(F.count("*").alias("n"))
