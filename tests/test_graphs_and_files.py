import json
import random
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from tagloom.operators import graphs, metagenres, splits, tree_fold
from tagloom.sources import files, gexf


def edges(spark, rows):
    return spark.createDataFrame([(a, b, float(w)) for a, b, w in rows], "from_tag string, to_tag string, weight double")


def cells(spark, matrix):
    names = "ABC"
    return spark.createDataFrame([(names[i], names[j], float(w)) for i, r in enumerate(matrix) for j, w in enumerate(r) if w], "a string, b string, w double")


def table(df):
    return {(r.a, r.b): round(r.w, 9) for r in df.collect()}


def test_adjacency(spark):
    rows = [(3, "oak", 4.0), (3, "elm", 2.0), (4, "elm", 9.0), (4, "yew", 1.0), (5, "elm", 7.0), (6, "elm", 1.0), (6, "oak", 1.0)]
    tags = spark.createDataFrame(rows, "track int, tag string, votes double")
    assert table(graphs.adjacency(tags)) == {("oak", "elm"): 1.0, ("elm", "oak"): 0.5, ("elm", "yew"): 0.25, ("yew", "elm"): 1.0}
    weighted = table(graphs.vote_weighted(tags))
    assert all(0 < w <= table(graphs.adjacency(tags))[k] for k, w in weighted.items())


def test_net_direction(spark):
    got = table(graphs.net_direction(cells(spark, [(0, 0.25, 0.7), (0.75, 0, 0.45), (0.05, 0.45, 0)])))
    # B gives A half more than it gets; A gives C 0.65 more; B and C are even
    assert {k: v for k, v in got.items() if v} == {("B", "A"): 0.5, ("A", "C"): 0.65}


def test_strongest_parent(spark):
    got = table(graphs.strongest_parent(cells(spark, [(0, 0.15, 0.35), (0.6, 0, 0.6), (0, 0, 0)])))
    # B's two are even, so the first by name; C has none
    assert got == {("A", "C"): 0.35, ("B", "A"): 0.6}


def test_root_levels_and_descendants(spark):
    g = edges(spark, [("twig", "bough", 1), ("leaf", "twig", 1), ("bough", "trunk", 1), ("nest", "bough", 1), ("root", "trunk", 1)])
    assert graphs.root_of(g) == "trunk"
    assert {r.tag_name: r.hierarchy_level for r in graphs.levels(g, "trunk").collect()} == {"trunk": 0, "bough": 1, "root": 1, "twig": 2, "nest": 2, "leaf": 3}
    assert {r.tag_name for r in graphs.descendants(g, "bough").collect()} == {"bough", "twig", "nest", "leaf"}
    for wrong in ([("A", "B", 1), ("A", "C", 1)], [("A", "B", 1), ("B", "A", 1)]):
        with pytest.raises(ValueError):
            graphs.root_of(edges(spark, wrong))


def test_family(spark):
    g = edges(spark, [("twig", "bough", 0.31), ("leaf", "twig", 0.11), ("bud", "twig", 0.17), ("nest", "bough", 0.05)])
    got = {(r.relation, r.tag_name, r.weight) for r in graphs.family(g, "twig").collect()}
    assert got == {("focus", "twig", None), ("parent", "bough", 0.31), ("child", "leaf", 0.11), ("child", "bud", 0.17)}


def triples(df):
    return sorted((r.from_tag, r.to_tag, r.weight) for r in df.collect())


def test_cycles_go_and_the_tree_stays(spark):
    # two cycles with a bridge, an edge of a vertex to itself, a cycle whose lightest edge is in the tree
    rows = [("a", "b", 5), ("b", "c", 2), ("c", "a", 4), ("c", "p", 9), ("p", "q", 1), ("q", "r", 8), ("r", "p", 7), ("s", "s", 3), ("q", "t", 6)]
    tree = edges(spark, [("p", "q", 1), ("b", "x", 1)])
    got = triples(graphs.without_cycles(edges(spark, rows), tree))
    assert got == sorted((a, b, float(w)) for a, b, w in rows if (a, b) not in {("b", "c"), ("r", "p"), ("s", "s")})
    clean = edges(spark, [("A", "B", 0.1), ("A", "C", 0.9)])
    assert triples(graphs.without_cycles(clean, clean.limit(0))) == triples(clean)
    with pytest.raises(ValueError):
        graphs.without_cycles(edges(spark, [("a", "b", 1), ("b", "a", 1)]), edges(spark, [("a", "b", 1), ("b", "a", 1)]))


def test_a_part_loses_edges_until_it_has_no_cycle(spark):
    pick = random.Random(7)
    rows = [(f"v{i}", f"v{j}", pick.randint(1, 30)) for i in range(4) for j in range(4) if i != j and pick.random() < 0.7]
    got = triples(graphs.without_cycles(edges(spark, rows), edges(spark, [])))
    left = {(a, b): w for a, b, w in rows}

    def reach(a):
        seen, todo = set(), [a]
        while todo:
            new = {y for x, y in left if x == todo[-1]} - seen
            todo.pop()
            seen |= new
            todo += new
        return seen

    while True:  # the rule, one part after the other
        parts = {frozenset(y for y in reach(x) if x in reach(y)) for x, _ in left} - {frozenset()}
        cyclic = [p for p in parts if any(a in p and b in p for a, b in left)]
        if not cyclic:
            break
        del left[min((e for e in left if e[0] in cyclic[0] and e[1] in cyclic[0]), key=lambda e: (left[e], e))]
    assert got == sorted((a, b, float(w)) for (a, b), w in left.items())


def test_parts(spark):
    rows = [("b", "a", 1), ("a", "b", 1), ("b", "m", 1), ("m", "y", 1), ("y", "z", 1), ("z", "y", 1), ("0", "a", 1), ("z", "9", 1)]
    assert {(r.tag, r.part) for r in graphs.strong_parts(edges(spark, rows)).collect()} == {("a", "a"), ("b", "a"), ("y", "y"), ("z", "y")}


def test_hierarchy(spark):
    g = edges(spark, [("b", "r", 1), ("a", "r", 1), ('c "x"', "a", 1), ("c2", "a", 1), ("c2", "b", 1)])
    nodes = spark.createDataFrame([('c "x"', 2.5, "#111111"), ("r", 1.0, graphs.BLACK), ("alone", 0.5, None)], "tag string, size double, fill string")
    got = {r.root: json.loads(r.json) for r in graphs.hierarchies(g, nodes).collect()}
    leaf = {"name": "c2", "size": 0, "fill": graphs.GREY}
    a = {"name": "a", "size": 0, "fill": graphs.GREY, "children": [{"name": 'c "x"', "size": 2.5, "fill": "#111111"}, leaf]}
    assert got == {"r": {"name": "r", "size": 1.0, "fill": graphs.BLACK, "children": [a, {"name": "b", "size": 0, "fill": graphs.GREY, "children": [leaf]}]}, "alone": {"name": "alone", "size": 0.5, "fill": graphs.GREY}}
    for wrong in ([("r", "r", 1)], [("a", "r", 1), ("r", "a", 1), ("a", "top", 1)]):
        with pytest.raises(ValueError):
            graphs.hierarchies(edges(spark, wrong), nodes)


def test_empty_pairs(spark):
    tags = spark.createDataFrame([("x",), ("y",), ("x",)], "tag string")
    assert table(graphs.empty_pairs(tags)) == {(a, b): 0.0 for a in "xy" for b in "xy"}


def test_sizes(spark):
    p = spark.createDataFrame([(1, "rock", 0.5), (1, "pop", 0.5), (2, "rock", 0.5), (2, "jazz", 0.5), (3, "pop", 1.0)], "track int, tag string, p double")
    assert {r.tag: r["size"] for r in graphs.tag_sizes(p).collect()} == {"rock": 1.0, "pop": 1.5, "jazz": 0.5, "ROOT": 0.001}


def test_gexf(spark, tmp_path):
    vertices = spark.createDataFrame([("A & B",), ("B & C",), ("C",)], "tag string")
    path = gexf.write_gexf(vertices, edges(spark, [("A & B", "B & C", 1), ("B & C", "C", 2)]), "x", str(tmp_path))
    text = open(path).read()
    assert text.count("&amp;") == 2 and sum(1 for e in ET.parse(path).iter() if e.tag.endswith("}edge")) == 2
    assert gexf.write_gexf(vertices, edges(spark, []), "y", str(tmp_path)) is None and not (tmp_path / "y.gexf").exists()


def test_files_round_trip(spark, tmp_path):
    rows = [("a;b", 'q"x"', "x, y", 1.5), ("2", None, "z", None)]
    df = spark.createDataFrame(rows, files.LONG)
    for sep in ",;":
        files.write_csv(df, str(tmp_path / f"c{ord(sep)}"), sep)
        assert {tuple(r) for r in files.read_csv(spark, str(tmp_path / f"c{ord(sep)}"), files.LONG, sep).collect()} == set(rows)
    nested = df.select("track", F.array(F.struct("tag_name", "tag_count")).alias("tags"))
    files.write_states({"order": nested, "sizes": df, "ginis": df}, str(tmp_path / "s"))
    back = files.read_states(spark, str(tmp_path / "s"))
    assert {r.track: r.tags[0].tag_name for r in back["order"].collect()} == {"a;b": "x, y", "2": "z"}


# Splits


def test_quantile_bins(spark):
    df = spark.createDataFrame([(k, float(x), float(x)) for k, x in enumerate([1, 2, 4, 10])], "artist int, popularity double, year double")
    got = splits.artist_strata(df).orderBy("artist").collect()
    assert [r.popularity_bin for r in got] == [None, 2, 3, 3] and got[0].stratum == "NA_NA"
    same = df.withColumn("year", F.lit(1.0))
    with pytest.raises(ValueError):
        splits.artist_strata(same)


def test_split_is_artist_disjoint(spark):
    df = spark.range(400).select((F.col("id") % 90).alias("artist"), F.col("id").alias("track"), (F.col("id") % 13).cast("double").alias("popularity"), (F.col("id") % 7).cast("double").alias("year"))
    split = splits.stratified_split(splits.artist_strata(df))
    train, test = splits.split_tracks(df, split)
    assert train.count() + test.count() == 400 and train.select("artist").intersect(test.select("artist")).count() == 0
    assert 0.6 < split.where("is_train").count() / 90 < 0.8


def test_capped_folds(spark):
    rows = [(t, a) for a, n in enumerate((1, 3, 5, 2)) for t in range(a * 10, a * 10 + n)]
    got = splits.capped_folds(spark.createDataFrame(rows, "track int, artist int"), 3, 2)
    assert got.count() == 7 and got.select("artist", "fold").distinct().count() == 4


def test_rare_levels(spark):
    rows = [("oak", "a")] * 40 + [("oak", "b")] * 30 + [("elm", "a")] * 12 + [("elm", "b")] * 9 + [("yew", "a")] * 3 + [("ash", "b")] * 25
    count = lambda least: {(r.grp, r.part): r["count"] for r in splits.remap_rare(spark.createDataFrame(rows, "grp string, part string"), "grp", "part", least).groupBy("grp", "part").count().collect()}
    # yew and ash are absent from a part; together they have 3 rows in a, which is enough for 2 but not for 4: then elm joins them
    assert count(2) == {("oak", "a"): 40, ("oak", "b"): 30, ("elm", "a"): 12, ("elm", "b"): 9, ("other", "a"): 3, ("other", "b"): 25}
    assert count(4) == {("oak", "a"): 40, ("oak", "b"): 30, ("other", "a"): 15, ("other", "b"): 34}


def test_distribution(spark):
    rows = [("train", 1, c) for c in ("rock", "rock", "rock", "pop", "pop")] + [("test", 1, "rock"), ("test", 1, "jazz")]
    got = splits.distribution(spark.createDataFrame(rows, "split_type string, split_id int, cat string"))
    assert {(r.split_type, r["cat"]): (r.n, r.share) for r in got.collect()} == {("train", "rock"): (3, 0.6), ("train", "pop"): (2, 0.4), ("test", "rock"): (1, 0.5), ("test", "jazz"): (1, 0.5)}


# Metagenres and the folded tree


def test_metagenres(spark):
    long = spark.createDataFrame([(4, "wood", 6.0), (4, "stone & clay", 2.0), (5, "iron", 7.0), (6, "wood", 1.0), (6, "iron", 3.0)], "track int, metagenre string, votes double")
    got = {(r.track, r.metagenre): r.p for r in metagenres.prevalences(long).collect()}
    assert got == {(4, "wood"): 0.75, (4, "stone & clay"): 0.25, (5, "iron"): 1.0, (6, "wood"): 0.25, (6, "iron"): 0.75}
    names = ["wood", "iron", "stone & clay"]
    mapping = spark.createDataFrame([(n, n) for n in names], "tag string, metagenre string")
    wide = {r.track: r for r in metagenres.mapped(long.withColumnRenamed("metagenre", "tag"), mapping, names).collect()}
    assert [wide[t].metagenre for t in (4, 5, 6)] == ["wood", "iron", "iron"]
    assert wide[5].p_wood == 0 and wide[4].p_stoneclay == 0.25 and wide[6].n_max == 3


def test_hard_class_of_a_tie_is_the_smaller(spark):
    shares = spark.createDataFrame([(1, "rock", 1.0, 0.5), (1, "jazz", 1.0, 0.5), (2, "rock", 9.0, 1.0)], "track int, metagenre string, n double, p double")
    assert {r.track: r.metagenre for r in metagenres.hard_classes(shares).collect()} == {1: "jazz", 2: "rock"}


BRANCHES = [("p", "m", 1), ("q", "m", 1), ("m", "top", 1), ("n", "top", 1), ("o", "n", 1)]
SONGS = {"p": 4, "q": 6, "m": 2, "n": 11, "o": 1, "top": 3}


def branches(spark):
    sizes = spark.createDataFrame([*SONGS.items()], "tag string, n long")
    return tree_fold.tour(edges(spark, BRANCHES), "top"), sizes


def test_tour(spark):
    tree, sizes = branches(spark)
    assert {r.tag: (r.parent, r.level, r.start, r.stop) for r in tree.collect()} == {"top": (None, 0, 1, 7), "m": ("top", 1, 2, 5), "p": ("m", 2, 3, 4), "q": ("m", 2, 4, 5), "n": ("top", 1, 5, 7), "o": ("n", 2, 6, 7)}
    assert {r.tag: r.all for r in tree_fold.sized(tree, sizes).collect()} == {"top": 27, "m": 12, "p": 4, "q": 6, "n": 12, "o": 1}
    for wrong in ([("a", "top", 1), ("a", "b", 1), ("b", "top", 1)], [("a", "b", 1), ("b", "a", 1)], [("a", "other", 1)]):
        with pytest.raises(ValueError):
            tree_fold.tour(edges(spark, wrong), "top")


def test_search_grid():
    assert tree_fold.search_grid(2, None, 5, 13) == [2, 7, 12, 13]
    assert tree_fold.search_grid(3, 9, 3, 99) == [3, 6, 9]


def test_current_genre_and_parent(spark):
    nodes = tree_fold.sized(*branches(spark))
    assert [r.tag for r in tree_fold.current_genre(nodes, ["o"]).collect()] == ["p"]
    assert tree_fold.current_genre(nodes, [*SONGS]).collect() == []
    # beside p, m and q hold 8
    assert tree_fold.parent_and_rest_are_large(nodes, "p", 8) is True and tree_fold.parent_and_rest_are_large(nodes, "p", 9) is False
    assert tree_fold.parent_and_rest_are_large(nodes, "top", 1) is None
    own = spark.createDataFrame([(t, t) for t in [*SONGS, "elsewhere"]], "tag string, cat string")
    assert {r.tag: r["cat"] for r in tree_fold.integrated(own, nodes, "m").collect()} == {t: "top" for t in SONGS} | {"elsewhere": "elsewhere"}
    assert {r.tag: r["cat"] for r in tree_fold.integrated(own, nodes, "q").collect() if r.tag != r["cat"]} == {"p": "m", "q": "m"}


def test_folding_a_tree(spark):
    tree, sizes = branches(spark)
    found = tree_fold.tune(tree, sizes, [1, 2, 5, 13, 100])
    mapped = {}
    for r in found["solutions"].collect():
        mapped.setdefault(r.min_n, {})[r.tag] = r["cat"]
    same = {t: t for t in SONGS}
    # o is under 2 and goes up; p is under 5 and takes q along; under 13 all meet at the top, where no Gini is left
    assert mapped == {1: same, 2: same | {"o": "n"}, 5: same | {"o": "n", "p": "m", "q": "m"}}
    ginis = {r.min_n: (r.n_metagenres, r.weighted_gini) for r in found["ginis"].collect()}
    assert {k: n for k, (n, _) in ginis.items()} == {1: 6, 2: 5, 5: 3} and all(0 <= g <= 1 for _, g in ginis.values())
    # sizes 3, 12, 12 with weights 1, 2, 2
    assert ginis[5][1] == pytest.approx(1 - (1 * 3 + 2 * (2 * 3 + 24) + 2 * (2 * 27 + 24)) / (5 * 51))
    parent = {a: b for a, b, _ in BRANCHES}
    for m in mapped.values():  # the parent of a category is a category
        assert all(parent[c] in m.values() for c in m.values() if c != "top")


@pytest.mark.parametrize("seed", range(3))
def test_folds_of_random_trees(spark, seed):
    from tests.test_entry import plain_tree_fold

    pick = random.Random(seed)
    parent = {f"t{k:02d}": f"t{pick.randrange(k):02d}" for k in range(1, 24)}
    sizes = {f"t{k:02d}": pick.choice([0, 0, 1, 2, 5, 9, 20]) for k in range(24)}
    tree = tree_fold.tour(edges(spark, [(a, b, 1) for a, b in parent.items()]), "t00")
    nodes = tree_fold.sized(tree, spark.createDataFrame([*sizes.items()], "tag string, n long"))
    got = {}
    for r in tree_fold.fold_trees(nodes, [1, 2, 4, 8, 16, 64]).collect():
        got.setdefault(r.min_n, {})[r.tag] = r["cat"]
    assert got == {m: plain_tree_fold(parent, sizes, m)[0] for m in (1, 2, 4, 8, 16, 64)}


def test_local_minimum_and_suggestion(spark):
    rows = list(zip((3, 5, 8, 9, 14, 20, 31), (0.71, 0.44, 0.52, 0.5, 0.2, 0.33, 0.32), strict=True))
    ginis = spark.createDataFrame(rows, "n_metagenres int, weighted_gini double")
    found = tree_fold.local_minima(ginis)
    assert sorted(r.n_metagenres for r in found.collect()) == [5, 14]
    assert tree_fold.suggested(found, 4, 20).first().n_metagenres == 14
    assert tree_fold.suggested(found, 15, 40).first().n_metagenres == 14
    assert tree_fold.suggested(found, 1, 2).count() == 0


def test_levels_of_any_depth(spark):
    """A chain, with short cuts and a cycle beside it that never leads to the root."""
    depth = 1500
    rows = [(f"v{k + 1}", f"v{k}", 1.0) for k in range(depth)] + [("v4", "v0", 1.0), ("w", "v2", 1.0), ("w", "v4", 1.0), ("x", "y", 1.0), ("y", "x", 1.0), ("v0", "x", 1.0)]
    got = {r.tag_name: r.hierarchy_level for r in graphs.levels(edges(spark, rows), "v0").collect()}
    assert got == {f"v{k}": k if k < 4 else k - 3 for k in range(depth + 1)} | {"w": 2}


def test_a_chain_takes_a_logarithmic_number_of_rounds(spark):
    chain = spark.range(1, 1501).select(F.concat(F.lit("v"), "id").alias("tag"), F.concat(F.lit("v"), F.col("id") - 1).alias("up"), F.lit(1).cast("long").alias("hops"))
    reach, rounds = graphs.jumped(chain, 20)
    assert rounds <= 12 and {(r.up, r.hops == int(r.tag[1:])) for r in reach.collect()} == {("v0", True)}
