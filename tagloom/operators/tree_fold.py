"""Folding a single-parent tree from the leaves by a least size, and the search for that size, for all sizes at once on tables.

A tree becomes a tour: every tag has an interval of places that holds the places of all below it. A subtree's size is then a difference of two sums,
a family moves by an interval, and the category of a tag is the outermost folded interval around its place.

The rule: the deepest category under the least size goes to its parent with its siblings and all below them. What a tag holds
when its turn comes is its subtree's size if one of its children was too small, else its own; so a level decides over the one above,
for every least size at the same time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions.ranks import placed, sums_before
from tagloom.sources.shared import discard, stored


def tour(edges: DataFrame, root: str | None) -> DataFrame:
    """tag, parent, level, start, stop of the tree edges(from_tag, to_tag): start numbers the tags, a parent before its children and those
    by name; the tags below a tag, itself included, have start in [start, stop).

    Paths to the root grow by doubling, in a logarithmic number of rounds; their order is that of the tour. Several parents, a cycle and a second root are errors; without a root there are no rows."""
    spark = edges.sparkSession
    if root is None:
        return spark.createDataFrame([], "tag string, parent string, level int, start long, stop long")
    pairs = edges.where(F.col("from_tag") != root).select("from_tag", "to_tag").distinct()
    first = spark.createDataFrame([(root, None, None, [root])], "tag string, parent string, up string, path array<string>")
    now = stored(first.unionByName(pairs.select(F.col("from_tag").alias("tag"), F.col("to_tag").alias("parent"), F.col("to_tag").alias("up"), F.array("from_tag").alias("path"))), "tour")
    n, tags = now.agg(F.count("*"), F.countDistinct("tag")).first()
    if n > tags:
        raise ValueError("a tag has several parents")
    for _ in range(n.bit_length() + 1):
        if now.where("up is not null").isEmpty():
            break
        ahead = now.select(F.col("tag").alias("up"), F.col("up").alias("next"), F.col("path").alias("above"))
        met = now.where("up is not null").join(ahead, "up")
        moved = met.select("tag", "parent", F.col("next").alias("up"), F.concat("above", "path").alias("path"))
        last, now = now, stored(now.where("up is null").unionByName(moved), "tour")
        discard(last)
    if not now.where("up is not null").isEmpty() or now.count() < n:
        raise ValueError("the tree holds a cycle or a second root")
    below = now.select(F.explode("path").alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))
    at = placed(now.select("tag", "parent", "path"), ["path"], "start")
    return stored(at.join(below, "tag").select("tag", "parent", (F.size("path") - 1).alias("level"), "start", (F.col("start") + F.col("n")).alias("stop")), "tour")


def sized(tree: DataFrame, sizes: DataFrame) -> DataFrame:
    """The tour with n, the size of a tag by sizes(tag, n) (0 if it has none), and all, that of its subtree: a difference of sums before places."""
    own = tree.join(sizes.select("tag", "n"), "tag", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    before = stored(sums_before(own, "start", "n"), "tour-sums")
    total = before.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"))  # one row
    ends = before.select(F.col("start").alias("stop"), F.col("before").alias("upto"))
    out = before.join(ends, "stop", "left").crossJoin(total).withColumn("all", F.coalesce("upto", "total") - F.col("before"))
    return stored(out.drop("before", "upto", "total"), "tour-sized")


def search_grid(least: int, most: int | None, step: int, largest: int) -> list[int]:
    """least, least + step, ...; without an upper bound up to the largest tag's size, which is included."""
    top = largest if most is None else most
    grid = list(range(least, top + 1, step))
    return grid if most is not None or grid[-1:] == [top] else [*grid, top]


def weighted_gini(rows: DataFrame, by: str) -> DataFrame:
    """by, n_metagenres, weighted_gini of rows(by, n, level), one a category: Gini of the sizes, each weighted by its distance to
    the root plus one (decision: the weighting isn't known); null for fewer than two categories or a zero sum."""
    w = F.col("level") + 1
    upto = F.coalesce(F.sum(F.col("n") * w).over(W.partitionBy(by).orderBy("n", "level").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    area = rows.withColumn("area", w * (2 * upto + F.col("n") * w))
    sums = area.groupBy(by).agg(F.count("*").alias("n_metagenres"), F.sum("area").alias("a"), F.sum(w).alias("w"), F.sum(F.col("n") * w).alias("t"))
    gini = F.when((F.col("n_metagenres") > 1) & (F.col("t") > 0), F.greatest(F.lit(0.0), 1 - F.col("a") / (F.col("w") * F.col("t"))))
    return sums.select(by, F.col("n_metagenres").cast("int").alias("n_metagenres"), gini.alias("weighted_gini"))


def current_genre(tree: DataFrame, checked: list[str]) -> DataFrame:
    """The deepest unchecked tag of the sized tour that has songs, of ties the first by name: one row or none."""
    return tree.where((F.col("n") > 0) & ~F.col("tag").isin(checked)).orderBy(F.desc("level"), "tag").limit(1)


def parent_and_rest_are_large(tree: DataFrame, tag: str, least: int) -> bool | None:
    """Would the parent, with what else lies under it, be a category of its own? None at the root."""
    own = tree.where(F.col("tag") == tag).select("parent", F.col("all").alias("mine"))
    found = own.join(tree.select(F.col("tag").alias("parent"), "all"), "parent").select((F.col("all") - F.col("mine")).alias("rest")).first()
    return None if found is None else found.rest >= least


def integrated(mapping: DataFrame, tree: DataFrame, tag: str) -> DataFrame:
    """mapping(tag, cat) after a tag, its siblings and all below them go to its parent: the categories in the parent's interval."""
    up = tree.where(F.col("tag") == tag).select(F.col("parent").alias("tag")).join(tree.select("tag", "start", "stop"), "tag").select(F.col("tag").alias("up"), F.col("start").alias("lo"), F.col("stop").alias("hi"))
    at = mapping.join(tree.select(F.col("tag").alias("cat"), "start"), "cat", "left").join(F.broadcast(up), (F.col("start") > F.col("lo")) & (F.col("start") < F.col("hi")), "left")  # one row
    return at.select("tag", F.coalesce("up", "cat").alias("cat"))


def fold_trees(tree: DataFrame, grid: list[int]) -> DataFrame:
    """min_n, tag, cat, n, level: where each tag of the sized tour goes, for every least size of the grid (level: the category's)."""
    spark = tree.sparkSession
    sizes = F.array(*(F.lit(m).cast("long") for m in grid))
    deepest = tree.agg(F.max("level")).first()[0]
    # folded(tag, min_n): the tags that take in all below them
    folded = None
    for level in range(deepest or 0, 0, -1):
        here = tree.where(F.col("level") == level).select("tag", "parent", "n", "all", F.explode(sizes).alias("min_n"))
        if folded is not None:
            here = here.join(folded.withColumn("takes", F.lit(True)), ["tag", "min_n"], "left")
        held = F.when(F.col("takes"), F.col("all")).otherwise(F.col("n")) if folded is not None else F.col("n")
        small = stored(here.where((held > 0) & (held < F.col("min_n"))).select(F.col("parent").alias("tag"), "min_n").distinct(), "folded")
        folded = small if folded is None else folded.unionByName(small)
    each = tree.select("tag", "n", "level", "start", "stop", F.explode(sizes).alias("min_n"))
    none = spark.createDataFrame([], "tag string, min_n long")
    marked = each.join((none if folded is None else folded).withColumn("takes", F.lit(True)), ["tag", "min_n"], "left")
    order = W.partitionBy("min_n").orderBy("start")  # the vocabulary, for each least size
    reach = F.max(F.when(F.col("takes"), F.col("stop"))).over(order.rowsBetween(W.unboundedPreceding, -1))
    inside = marked.withColumn("inside", F.coalesce(reach > F.col("start"), F.lit(False)))
    outer = F.last(F.when(F.col("takes") & ~F.col("inside"), F.struct("tag", "level")), True).over(order)
    cat = F.when(F.col("inside"), outer).otherwise(F.struct("tag", "level"))
    return inside.withColumn("to", cat).select("min_n", "tag", F.col("to.tag").alias("cat"), "n", F.col("to.level").alias("level"))


def tune(tree: DataFrame, sizes: DataFrame, grid: list[int]) -> dict[str, DataFrame]:
    """ginis(min_n, n_metagenres, weighted_gini) and solutions(min_n, tag, cat) of the tags of sizes(tag, n), up to the first undefined Gini."""
    nodes = sized(tree, sizes)
    mapped = stored(fold_trees(nodes, grid).join(sizes.select("tag"), "tag", "left_semi"), "tree-folds")
    ginis = stored(weighted_gini(mapped.groupBy("min_n", "cat").agg(F.sum("n").alias("n"), F.first("level").alias("level")), "min_n"), "tree-ginis")
    first = ginis.where("weighted_gini is null").agg(F.min("min_n").alias("first"))  # one row
    good = ginis.crossJoin(first).where("first is null or min_n < first").drop("first")
    return {"ginis": good, "solutions": mapped.select("min_n", "tag", "cat").join(good.select("min_n"), "min_n", "left_semi")}


def local_minima(ginis: DataFrame) -> DataFrame:
    """Rows of (n_metagenres, weighted_gini, ...) that lie below both neighbours."""
    w = W.orderBy("n_metagenres")  # one row per grid point
    return ginis.withColumns({"__b": F.lag("weighted_gini").over(w), "__a": F.lead("weighted_gini").over(w)}).where("weighted_gini < __b and weighted_gini < __a").drop("__a", "__b")


def suggested(candidates: DataFrame, low: int, high: int) -> DataFrame:
    """The candidate within the range with the least Gini, else the one with the most categories below it."""
    inside = F.col("n_metagenres").between(low, high)
    return candidates.where(inside | (F.col("n_metagenres") < low)).orderBy(F.desc(inside), F.when(inside, F.col("weighted_gini")), F.desc("n_metagenres")).limit(1)
