"""Single-parent trees and small graphs: co-occurrence, net direction, levels, families.

Edges run from a tag to its parent: (from_tag, to_tag, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.sources.shared import discard, stored

GREY, BLACK = "#808080", "#000000"
ROOT = "ROOT"
ROOT_SIZE = 0.001


def tag_pairs(tags: DataFrame) -> DataFrame:
    """track, a, b: ordered pairs of different tags within a track."""
    x, y = tags.select("track", F.col("tag").alias("a")), tags.select("track", F.col("tag").alias("b"))
    return x.join(y, "track").where("a <> b")


def adjacency(tags: DataFrame) -> DataFrame:
    """a, b, w: tracks with both over tracks with a. Only tags that meet have a row."""
    once = tags.select("track", "tag").distinct()
    both = tag_pairs(once).groupBy("a", "b").agg(F.count("*").alias("n"))
    alone = once.groupBy(F.col("tag").alias("a")).agg(F.count("*").alias("m"))
    return both.join(alone, "a").select("a", "b", (F.col("n") / F.col("m")).alias("w"))


def vote_weighted(tags: DataFrame) -> DataFrame:
    """a, b, w: as adjacency, each track counting by b's share of the votes of the two (decision: the formula is left open;
    it is positive and never above the plain weight)."""
    x, y = tags.select("track", F.col("tag").alias("a"), F.col("votes").alias("va")), tags.select("track", F.col("tag").alias("b"), F.col("votes").alias("vb"))
    both = x.join(y, "track").where("a <> b").groupBy("a", "b").agg(F.sum(F.col("vb") / (F.col("va") + F.col("vb"))).alias("s"))
    alone = tags.groupBy(F.col("tag").alias("a")).agg(F.countDistinct("track").alias("m"))
    return both.join(alone, "a").select("a", "b", (F.col("s") / F.col("m")).alias("w"))


def net_direction(w: DataFrame) -> DataFrame:
    """a, b, w: what is left of the stronger direction after taking off the weaker."""
    back = w.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("w").alias("v"))
    return w.join(back, ["a", "b"], "left").select("a", "b", F.greatest(F.lit(0.0), F.col("w") - F.coalesce("v", F.lit(0.0))).alias("w"))


def strongest_parent(w: DataFrame) -> DataFrame:
    """a, b, w: each a's heaviest b, of ties the first by name; rows of zero weight have no parent."""
    best = F.min(F.struct((-F.col("w")).alias("less"), "b", "w")).alias("x")
    return w.where("w > 0").groupBy("a").agg(best).select("a", "x.b", "x.w")


def build_tree(tags: DataFrame, *, weighted: bool = False) -> DataFrame:
    """from_tag, to_tag, weight: each tag's strongest parent by net co-occurrence."""
    w = vote_weighted(tags) if weighted else adjacency(tags)
    return strongest_parent(net_direction(w)).toDF("from_tag", "to_tag", "weight")


def root_of(edges: DataFrame) -> str | None:
    """The one vertex without a parent; null where there are no edges."""
    if edges.isEmpty():
        return None
    found = edges.select("to_tag").subtract(edges.select(F.col("from_tag").alias("to_tag"))).limit(2).collect()
    if len(found) != 1:
        raise ValueError(f"{len(found) or 'no'} roots")
    return found[0].to_tag


def jumped(pointers: DataFrame, most: int) -> tuple[DataFrame, int]:
    """pointers(tag, up, hops), one row a tag, with up moved on to the first vertex that isn't a tag itself, and the rounds it took.

    Pointer doubling: a round takes every tag as far again, so a chain of n is followed in log2(n) rounds, each a stored table.
    Tags of a cycle, and those that lead into one, are still at a tag after `most` rounds, and are left out."""
    now, rounds = stored(pointers.withColumn("open", F.lit(True)), "pointers"), 0
    while rounds < most:
        ahead = now.select(F.col("tag").alias("up"), F.col("up").alias("next"), F.col("hops").alias("more"), F.col("open").alias("on"))
        met = now.where("open").join(ahead, "up", "left")
        moved = met.select("tag", F.coalesce("next", "up").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), F.coalesce("on", F.lit(False)).alias("open"))
        last, now, rounds = now, stored(moved.unionByName(now.where("not open")), "pointers"), rounds + 1
        discard(last)
        if now.where("open").isEmpty():
            break
    return now.where("not open").drop("open"), rounds


def levels(edges: DataFrame, root: str | None) -> DataFrame:
    """tag_name, hierarchy_level: fewest edges to the root, which has 0, of every vertex that leads to it; no rows without a root.

    Vertices with one parent point to it and are followed by doubling up to the root or to a vertex with several parents; those, if there are any, are settled by rounds
    of least sums over the edges between them. A chain of any length takes a logarithmic number of rounds, and nothing reaches the driver."""
    spark = edges.sparkSession
    if root is None:
        return spark.createDataFrame([], "tag_name string, hierarchy_level int")
    pairs = stored(edges.where((F.col("from_tag") != root) & (F.col("from_tag") != F.col("to_tag"))).select("from_tag", "to_tag").distinct(), "levels-edges")
    parents = stored(pairs.groupBy(F.col("from_tag").alias("tag")).agg(F.min("to_tag").alias("up"), F.count("*").alias("n")), "levels-parents")
    single = parents.where("n = 1").select("tag", "up", F.lit(1).cast("long").alias("hops"))
    reach, _ = jumped(single, max(1, parents.count()).bit_length() + 1)
    start = spark.createDataFrame([(root, 0)], "tag string, d long")
    several = parents.where("n > 1").select("tag")
    known = start
    if not several.isEmpty():
        links = pairs.join(several, F.col("from_tag") == F.col("tag"), "left_semi").join(reach, F.col("to_tag") == F.col("tag"), "left")
        links = stored(links.groupBy(F.col("from_tag").alias("tag"), F.coalesce("up", "to_tag").alias("up")).agg((F.min(F.coalesce("hops", F.lit(0))) + 1).alias("hops")), "levels-links")
        known, before = stored(start, "levels-known"), None
        while before != (state := tuple(known.agg(F.count("*"), F.sum("d")).first())):
            nearer = links.join(known.select(F.col("tag").alias("up"), "d"), "up").select("tag", (F.col("hops") + F.col("d")).alias("d"))
            last, known, before = known, stored(known.unionByName(nearer).groupBy("tag").agg(F.min("d").alias("d")), "levels-known"), state
            discard(last)
    ends = reach.join(known.select(F.col("tag").alias("up"), "d"), "up").select("tag", (F.col("hops") + F.col("d")).alias("d"))
    return known.unionByName(ends).select(F.col("tag").alias("tag_name"), F.col("d").cast("int").alias("hierarchy_level"))


def descendants(edges: DataFrame, node: str) -> DataFrame:
    """tag_name of a node and of all that lead to it."""
    return levels(edges, node).select("tag_name")


def family(edges: DataFrame, node: str | None) -> DataFrame:
    """relation (focus, parent, child), tag_name, weight around a node; no rows around none."""
    focus = edges.sparkSession.createDataFrame([("focus", node, None)] * (node is not None), "relation string, tag_name string, weight double")
    parents = edges.where(F.col("from_tag") == node).select(F.lit("parent").alias("relation"), F.col("to_tag").alias("tag_name"), "weight")
    children = edges.where(F.col("to_tag") == node).select(F.lit("child").alias("relation"), F.col("from_tag").alias("tag_name"), "weight")
    return focus.unionByName(parents).unionByName(children)


def tag_sizes(p: DataFrame, root: str = ROOT) -> DataFrame:
    """tag, size: sum of vote shares; the root has a token size."""
    sizes = p.groupBy("tag").agg(F.sum("p").alias("size"))
    return sizes.where(F.col("tag") != root).unionByName(p.sparkSession.createDataFrame([(root, ROOT_SIZE)], "tag string, size double"))


def fills(tags: DataFrame, root: str = ROOT) -> DataFrame:
    return tags.select("tag", F.when(F.col("tag") == root, BLACK).otherwise(GREY).alias("fill"))


def edge_keys(edges: DataFrame) -> DataFrame:
    """key "from->to", weight."""
    return edges.select(F.concat("from_tag", F.lit("->"), "to_tag").alias("key"), "weight")


def empty_pairs(tags: DataFrame) -> DataFrame:
    """a, b, w: every ordered pair of a vocabulary's tags, equal ones too, with zero weight: vocabulary times vocabulary rows."""
    names = tags.select("tag").distinct()
    return names.select(F.col("tag").alias("a")).crossJoin(names.select(F.col("tag").alias("b"))).withColumn("w", F.lit(0.0))


def _json(text: str) -> Column:
    """A string as JSON has it."""
    return F.regexp_extract(F.to_json(F.struct(F.col(text).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)


def hierarchies(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """root, json of each vertex without a parent: name, size and fill of nodes(tag, size, fill), and its children in order of their names, nested.

    Bottom-up: a vertex is written once all its children are, so the rounds are as many as the tree has levels. A tag that is
    its own ancestor never is, which is an error; one with several parents stands under each."""
    pairs = stored(edges.select("from_tag", "to_tag").distinct(), "hierarchy-edges")
    tags = pairs.select(F.explode(F.array("from_tag", "to_tag")).alias("tag")).unionByName(nodes.select("tag")).distinct()
    head = F.concat(F.lit('{"name":'), _json("tag"), F.lit(',"size":'), F.coalesce(F.col("size").cast("string"), F.lit("0")), F.lit(',"fill":'), _json("fill"))
    known = tags.join(nodes, "tag", "left").withColumn("fill", F.coalesce("fill", F.lit(GREY)))
    described = stored(known.select("tag", head.alias("head")), "hierarchy-nodes")
    inner = pairs.select(F.col("to_tag").alias("tag")).distinct()
    done = stored(described.join(inner, "tag", "left_anti").select("tag", F.concat("head", F.lit("}")).alias("json")), "hierarchy")
    left = stored(pairs.groupBy(F.col("to_tag").alias("tag")).agg(F.count("*").alias("n")), "hierarchy-left")
    while not left.isEmpty():
        open_ = pairs.join(left.select(F.col("tag").alias("to_tag")), "to_tag", "left_semi")
        met = open_.join(done, F.col("from_tag") == F.col("tag")).groupBy(F.col("to_tag").alias("tag")).agg(F.count("*").alias("have"), F.array_sort(F.collect_list(F.struct("from_tag", "json"))).alias("below"))
        ready = met.join(left, "tag").where("have = n").join(described, "tag")
        children = F.array_join(F.transform("below", lambda x: x["json"]), ",")
        new = stored(ready.select("tag", F.concat("head", F.lit(',"children":['), children, F.lit("]}")).alias("json")), "hierarchy")
        if new.isEmpty():
            raise ValueError(f"{left.agg(F.min('tag')).first()[0]} is its own ancestor, or leads to one that is")
        left = stored(left.join(new, "tag", "left_anti"), "hierarchy-left")
        done = done.unionByName(new)
    return done.join(pairs.select(F.col("from_tag").alias("tag")).distinct(), "tag", "left_anti").select(F.col("tag").alias("root"), "json")


#: Steps of peeling and of spreading that one stored table takes.
AT_ONCE = 3


def peeled(pairs: DataFrame) -> DataFrame:
    """The edges (from_tag, to_tag) between vertices that neither start nor end a path: sources and sinks go until none is left."""
    now = stored(pairs.select("from_tag", "to_tag"), "peel")
    n, before = now.count(), None
    while n and n != before:
        kept = now
        for _ in range(AT_ONCE):
            inner = kept.select(F.col("from_tag").alias("v")).intersect(kept.select(F.col("to_tag").alias("v")))
            kept = kept.join(inner.withColumnRenamed("v", "from_tag"), "from_tag", "left_semi").join(inner.withColumnRenamed("v", "to_tag"), "to_tag", "left_semi")
        last, now = now, stored(kept.select("from_tag", "to_tag"), "peel")
        discard(last)
        n, before = now.count(), n
    return now


def _spread(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """names(tag, c) with the least c among a tag and all that reach it along pairs(from_tag, to_tag)."""
    now, before = stored(names, "colours"), None
    while before != (state := tuple(now.agg(F.count("*"), F.sum(F.xxhash64("tag", "c").cast("decimal(38,0)"))).first())):
        further = now
        for _ in range(AT_ONCE):
            ahead = pairs.join(further.withColumnRenamed("tag", "from_tag"), "from_tag").select(F.col("to_tag").alias("tag"), "c")
            further = further.unionByName(ahead).groupBy("tag").agg(F.min("c").alias("c"))
        last, now, before = now, stored(further, "colours"), state
        discard(last)
    return now


def strong_parts(pairs: DataFrame) -> DataFrame:
    """tag, part: the strongly connected part of each vertex that lies on a cycle of pairs(from_tag, to_tag).

    A round colours each vertex by the least name that reaches it; those of a colour that also reach the vertex of that name are a part. The
    others stay, without their edges to other colours and less what no longer lies on a cycle, for the next round."""
    now, found = peeled(pairs), None
    while not now.isEmpty():
        tags = now.select(F.explode(F.array("from_tag", "to_tag")).alias("tag")).distinct()
        colour = _spread(now, tags.withColumn("c", F.col("tag")))
        named = now.join(colour.select(F.col("tag").alias("from_tag"), F.col("c").alias("x")), "from_tag").join(colour.select(F.col("tag").alias("to_tag"), F.col("c").alias("y")), "to_tag")
        same = stored(named.where("x = y").select("from_tag", "to_tag"), "same-colour")
        back = _spread(same.select(F.col("to_tag").alias("from_tag"), F.col("from_tag").alias("to_tag")), colour.where("tag = c"))
        part = stored(back.select("tag", F.col("c").alias("part")), "strong-parts")
        found = part if found is None else found.unionByName(part)
        inside = part.select("tag")
        rest = same.join(inside.withColumnRenamed("tag", "from_tag"), "from_tag", "left_anti").join(inside.withColumnRenamed("tag", "to_tag"), "to_tag", "left_anti")
        now = peeled(rest)
    if found is None:
        return pairs.sparkSession.createDataFrame([], "tag string, part string")
    return found.join(found.groupBy("part").agg(F.count("*").alias("n")).where("n > 1").select("part"), "part", "left_semi").select("tag", "part")


def without_cycles(edges: DataFrame, tree: DataFrame) -> DataFrame:
    """edges(from_tag, to_tag, weight) less the lightest edges on cycles, none of them in tree(from_tag, to_tag): while there are
    cycles, every strongly connected part loses its lightest edge that isn't in the tree, of ties the first by name.

    All parts lose theirs in one round, so the rounds are as many as the part with the most such edges has. A tree that holds a cycle is an error."""
    keep = tree.select("from_tag", "to_tag").distinct().withColumn("in_tree", F.lit(True))
    now, removed = edges.select("from_tag", "to_tag", "weight"), None
    while True:
        parts = stored(strong_parts(now.where("from_tag <> to_tag").select("from_tag", "to_tag").distinct()), "parts")
        name = lambda c: parts.select(F.col("tag").alias(c), F.col("part").alias(f"of_{c}"))
        within = now.join(name("from_tag"), "from_tag").join(name("to_tag"), "to_tag").where("of_from_tag = of_to_tag and from_tag <> to_tag")
        inside = stored(within.select("from_tag", "to_tag", "weight", F.col("of_from_tag").alias("part")), "cyclic")
        if removed is None:  # an edge of a vertex to itself is a cycle of its own
            inside = inside.unionByName(now.where("from_tag = to_tag").withColumn("part", F.concat(F.lit("loop "), "from_tag")))
        light = inside.join(keep, ["from_tag", "to_tag"], "left").groupBy("part").agg(F.min(F.when(F.col("in_tree").isNull(), F.struct("weight", "from_tag", "to_tag"))).alias("x"))
        gone = stored(light, "lightest")
        if gone.isEmpty():
            break
        if not gone.where("x is null").isEmpty():
            raise ValueError("the tree holds a cycle")
        gone = gone.select("x.from_tag", "x.to_tag")
        removed = gone if removed is None else removed.unionByName(gone)
        now = inside.join(gone, ["from_tag", "to_tag"], "left_anti").select("from_tag", "to_tag", "weight")  # what lies between parts is on no cycle
    return edges if removed is None else edges.join(removed, ["from_tag", "to_tag"], "left_anti").select(edges.columns)
