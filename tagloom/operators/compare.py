"""Comparison of categories with other taxonomies, and of two foldings with each other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions import stats
from tagloom.operators import assign


def shared_tracks(*frames: DataFrame) -> DataFrame:
    out = frames[0].select("track").distinct()
    for f in frames[1:]:
        out = out.join(f.select("track").distinct(), "track", "left_semi")
    return out


def correlation_table(first: DataFrame, second: DataFrame) -> dict[str, DataFrame]:
    """Of two long memberships (track, cat, p) over their common tracks: cells(a, b, corr, prev_a, prev_b) by rank correlation,
    and the Gini of each one's label counts."""
    sides = stats.side_by_side(first, second)
    prevalence = {}
    for name in ("a", "b"):
        # a track's categories are in its row: the most probable, of ties the first by name, as in assign.labels
        label = F.array_min(F.transform(name, lambda e: F.struct((-F.round(e.p, assign.DIGITS)).alias("less"), e.cat.alias("cat")))).getField("cat")
        prevalence[name] = assign.prevalences(sides.select(label.alias("cat")), sides.select(F.explode(F.array_distinct(F.transform(name, lambda e: e.cat))).alias("cat")).distinct())
    cells = stats.spearman_cells(sides)
    for name, df in prevalence.items():
        cells = cells.join(df.select(F.col("cat").alias(name), F.col("share").alias(f"prev_{name}")), name)
    ginis = stats.gini(prevalence["a"], "n").select(F.lit("a").alias("side"), "gini").unionByName(stats.gini(prevalence["b"], "n").select(F.lit("b").alias("side"), "gini"))
    return {"cells": cells, "ginis": ginis}


def rarest_category(external: DataFrame) -> DataFrame:
    """track, cat: of a track's external tags (track, tag) the one with the fewest rows, of ties the first by name."""
    counts = external.groupBy("tag").agg(F.count("*").alias("n"))
    return external.join(F.broadcast(counts), "tag").groupBy("track").agg(F.min(F.struct("n", "tag")).alias("x")).select("track", F.col("x.tag").alias("cat"))


def mean_probabilities(external: DataFrame, q: DataFrame, cats: DataFrame) -> DataFrame:
    """ext_cat, cat, mean_prob, prev_ext, prev_cat: mean membership of tracks per external category; an absent category counts as zero."""
    ext = external.select("track", F.col("cat").alias("ext_cat")).join(shared_tracks(q), "track", "left_semi")
    size = ext.groupBy("ext_cat").agg(F.count("*").alias("n"))
    sums = ext.join(q, "track").groupBy("ext_cat", "cat").agg(F.sum("p").alias("s"))
    cells = size.crossJoin(cats.select("cat")).join(sums, ["ext_cat", "cat"], "left")  # one row per pair of categories
    mean = cells.select("ext_cat", "cat", (F.coalesce("s", F.lit(0.0)) / F.col("n")).alias("mean_prob"))
    both = ext.select("track")
    prev_ext = assign.prevalences(ext.select(F.col("ext_cat").alias("cat")), size.select(F.col("ext_cat").alias("cat"))).select(F.col("cat").alias("ext_cat"), F.col("share").alias("prev_ext"))
    prev_cat = assign.prevalences(assign.labels(q.join(both, "track", "left_semi")), cats).select("cat", F.col("share").alias("prev_cat"))
    return mean.join(prev_ext, "ext_cat").join(prev_cat, "cat")


def mapping_differences(first: DataFrame, second: DataFrame) -> DataFrame:
    """tag, cat, d: first less second of two mappings (tag, cat, w), over the cells that either has."""
    x, y = first.select("tag", "cat", F.col("w").alias("x")), second.select("tag", "cat", F.col("w").alias("y"))
    return x.join(y, ["tag", "cat"], "full").na.fill(0.0, ["x", "y"]).select("tag", "cat", (F.col("x") - F.col("y")).alias("d"))


def robustness(p: DataFrame, first: DataFrame, second: DataFrame) -> dict[str, DataFrame]:
    """Of two mappings over the same tags: t-test of the differences, divergence per tag, macro F1 of the tracks' labels."""
    labels = lambda m, to: assign.labels(assign.probabilities(p, m)).select("track", F.col("cat").alias(to))
    return {
        "test": stats.t_statistic(mapping_differences(first, second), "d"),
        "divergence": stats.jensen_shannon(first, second),
        "f1": stats.macro_f1(labels(first, "truth").join(labels(second, "guess"), "track")),
    }


def ward_merges(distance: list[list[float]]) -> list[tuple[int, int, float]]:
    """Ward's clustering of n items on squared distances: (left, right, height) of each merge by height, for tens of categories.

    An item is its place, the cluster of the k-th merge is n + k; of two, the one formed first stands left (items before clusters).
    By nearest-neighbour chains: each cluster looks for its nearest only, and two that are each other's nearest merge, which gives the same tree as a
    search over all pairs in each step."""
    n = len(distance)
    d = {i: {j: distance[i][j] ** 2 for j in range(n) if j != i} for i in range(n)}
    size = dict.fromkeys(range(n), 1)
    found, chain = [], []
    while len(d) > 1:
        if not chain:
            chain = [min(d)]
        x = chain[-1]
        back = chain[-2] if len(chain) > 1 else None
        y = min(d[x], key=lambda k: (d[x][k], k != back, k))
        if y != back:
            chain.append(y)
            continue
        chain = chain[:-2]
        new, dxy = n + len(found), d[x][y]
        found.append((x, y, dxy**0.5))
        a, b = size.pop(x), size.pop(y)
        dx, dy = d.pop(x), d.pop(y)
        d[new] = {}
        for k in size:
            d[k].pop(x)
            d[k].pop(y)
            d[k][new] = d[new][k] = ((a + size[k]) * dx[k] + (b + size[k]) * dy[k] - size[k] * dxy) / (a + b + size[k])
        size[new] = a + b
    order = sorted(range(len(found)), key=lambda k: (found[k][2], k))
    number = {n + k: n + place for place, k in enumerate(order)} | {i: i for i in range(n)}
    return [(*sorted((number[found[k][0]], number[found[k][1]])), found[k][2]) for k in order]


def cluster_order(distance: list[list[float]]) -> list[int]:
    """The leaves of Ward's tree from left to right."""
    n = len(distance)
    leaves = [[i] for i in range(n)]
    for left, right, _ in ward_merges(distance):
        leaves.append(leaves[left] + leaves[right])
    return leaves[-1] if leaves else []


def _square(cells: DataFrame) -> tuple[list[str], list[list[float]]]:
    """Names and rows of a square long table (a, b, corr); a missing cell is 0, and 1 on the diagonal. Of categories, so it is small."""
    at = {(r.a, r.b): r["corr"] for r in cells.collect()}
    names = sorted({x for pair in at for x in pair})
    return names, [[1.0 if a == b else at.get((a, b)) or 0.0 for b in names] for a in names]


def clustered(cells: DataFrame) -> DataFrame:
    """part, place, name, height of the categories of cells(a, b, corr) by Ward's clustering of 1 - corr: each merge with its members, and each leaf in order."""
    names, corr = _square(cells)
    distance = [[1 - x for x in row] for row in corr]
    members = [[n] for n in names]
    rows = []
    for k, (left, right, height) in enumerate(ward_merges(distance)):
        members.append(sorted(members[left] + members[right]))
        rows.append(("merge", k + 1, ";".join(members[-1]), height))
    rows += [("leaf", k + 1, names[i], None) for k, i in enumerate(cluster_order(distance))]
    return cells.sparkSession.createDataFrame(rows, "part string, place int, name string, height double")


#: Rounds of the power iteration for each of the two leading eigenvectors.
ROUNDS = 200


def eigen_angles(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """cat, e1, e2, angle of the categories of a symmetric cells(a, b, corr): components of the two leading eigenvectors, and the
    angle by which they are ordered. A vector's component of the greatest size (of ties the first) is positive.

    Power iteration, then once more on what the first vector leaves (deflation), as one native expression over the rows of the table: a matrix of
    categories, one row of it per category, in one row."""
    row = cells.groupBy("a").agg(F.array_sort(F.collect_list(F.struct("b", F.coalesce("corr", F.lit(0.0)).alias("w")))).alias("r"))
    matrix = row.agg(F.array_sort(F.collect_list(F.struct("a", "r"))).alias("m")).select(F.expr("transform(m, x -> x.a)").alias("names"), F.expr("transform(m, x -> transform(x.r, y -> y.w))").alias("m"))
    dot = lambda x, y: f"aggregate(zip_with({x}, {y}, (p, q) -> p * q), 0D, (s, t) -> s + t)"
    scaled = lambda v: f"transform(array({v}), u -> transform(u, x -> coalesce(try_divide(x, sqrt({dot('u', 'u')})), 0D)))[0]"
    start = "transform(names, (x, i) -> 1D + i / size(names))"
    power = lambda m: scaled(f"aggregate(sequence(1, {rounds}), {start}, (v, k) -> {scaled(f'transform({m}, z -> {dot("z", "v")})')})")
    signed = lambda v: f"transform(array({v}), u -> transform(u, x -> x * coalesce(sign(filter(u, y -> abs(y) >= array_max(transform(u, w -> abs(w))) - 1e-9)[0]), 1D)))[0]"
    first = matrix.withColumn("e1", F.expr(power("m"))).withColumn("l1", F.expr(dot("e1", f"transform(m, z -> {dot('z', 'e1')})")))
    rest = first.withColumn("m2", F.expr("transform(m, (z, i) -> transform(z, (x, j) -> x - l1 * e1[i] * e1[j]))"))
    both = rest.withColumn("e2", F.expr(power("m2"))).select("names", F.expr(signed("e1")).alias("e1"), F.expr(signed("e2")).alias("e2"))
    each = both.select(F.explode(F.arrays_zip("names", "e1", "e2")).alias("x")).select(F.col("x.names").alias("cat"), "x.e1", "x.e2")
    angle = F.when(F.col("e1") == 0, F.signum("e2") * F.lit(1.5707963267948966)).otherwise(F.atan(F.col("e2") / F.col("e1")))
    return each.withColumn("angle", F.when(F.col("e1") > 0, angle).otherwise(angle + F.lit(3.141592653589793)))


def eigen_order(cells: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """eigen_angles with place, from 1: ascending angles, of ties the first by name (angles tie at 9 decimals)."""
    return eigen_angles(cells, rounds).withColumn("place", F.row_number().over(W.orderBy(F.round("angle", 9), "cat")))  # one row per category
