import math
import random
import shutil
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import stats
from tagloom.operators import compare, splits, tree_fold
from tagloom.plans import inputs, registry
from tagloom.sources import arrow_files, gexf

D = "/root/testdata/sf0.001"


def plain_ward(d):
    """Merges by a search over all pairs in each step: the members and the height of each."""
    clusters = {frozenset([i]): None for i in range(len(d))}
    dist = {frozenset([frozenset([i]), frozenset([j])]): d[i][j] ** 2 for i in range(len(d)) for j in range(i)}
    out = []
    while len(clusters) > 1:
        pair = min(dist, key=lambda p: dist[p])
        x, y = pair
        dxy, new = dist[pair], x | y
        for k in [c for c in clusters if c not in pair]:
            dx, dy = dist[frozenset([x, k])], dist[frozenset([y, k])]
            n = len(x) + len(y) + len(k)
            dist[frozenset([new, k])] = ((len(x) + len(k)) * dx + (len(y) + len(k)) * dy - len(k) * dxy) / n
        dist = {p: v for p, v in dist.items() if not p & pair}
        clusters = {c: None for c in clusters if c not in pair} | {new: None}
        out.append((new, dxy**0.5))
    return out


@pytest.mark.parametrize("n", [2, 3, 9, 25])
def test_chains_give_the_tree_of_the_full_search(n):
    pick = np.random.default_rng(n)
    d = np.abs(pick.random((n, n)))
    d = ((d + d.T) / 2).tolist()
    members = [frozenset([i]) for i in range(n)]
    for (left, right, height), (want, level) in zip(compare.ward_merges(d), plain_ward(d), strict=True):
        members.append(members[left] | members[right])
        assert members[-1] == want and height == pytest.approx(level)
    order = compare.cluster_order(d)
    assert sorted(order) == list(range(n))
    for m in members:  # a cluster's leaves stand together
        at = sorted(order.index(i) for i in m)
        assert at == list(range(at[0], at[0] + len(m)))


def test_hand_made_clusters():
    d = [[0, 6, 1, 6], [6, 0, 6, 2], [1, 6, 0, 6], [6, 2, 6, 0]]
    assert compare.ward_merges(d) == [(0, 2, 1.0), (1, 3, 2.0), (4, 5, pytest.approx(math.sqrt(2 * 36 - (1 + 4) / 2 * 1.0)))]
    assert compare.cluster_order(d) == [0, 2, 1, 3] and compare.cluster_order([[0]]) == [0] and compare.cluster_order([]) == []


def cells(spark, names, m):
    return spark.createDataFrame([(a, b, float(m[i][j])) for i, a in enumerate(names) for j, b in enumerate(names)], "a string, b string, corr double")


@pytest.mark.parametrize("seed", [1, 2])
def test_eigenvectors_as_numpy_has_them(spark, seed):
    pick = np.random.default_rng(seed)
    x = pick.standard_normal((6, 40)) + 2 * pick.standard_normal(40) * np.array([1, 1, 1, 0, 0, 0.5])[:, None]
    m, names = np.corrcoef(x), list("pqrstu")
    values, vectors = np.linalg.eigh(m)
    got = {r["cat"]: r for r in compare.eigen_order(cells(spark, names, m)).collect()}
    for k, name in ((-1, "e1"), (-2, "e2")):
        v = vectors[:, k] * np.sign(vectors[np.argmax(np.abs(vectors[:, k])), k])
        assert [got[n][name] for n in names] == pytest.approx(v.tolist(), abs=1e-4)
    angle = [math.atan(got[n].e2 / got[n].e1) + (0 if got[n].e1 > 0 else math.pi) for n in names]
    assert [n for _, n in sorted(zip(angle, names, strict=True))] == sorted(names, key=lambda n: got[n].place)


def test_student_t_in_sql(spark):
    # quantiles of printed tables
    rows = [(2.228138852, 10, 0.05), (-12.706204736, 1, 0.05), (0.0, 5, 1.0), (3.169272667, 10, 0.01), (1.959963985, 100_000_000, 0.05), (1.0, 1, 0.5), (40.0, 7, 1.6e-9)]
    got = spark.createDataFrame([(t, df) for t, df, _ in rows] + [(1.0, 0), (None, 3)], "t double, df long").select(stats.t_p_value("t", "df").alias("p")).collect()
    for r, (_, df, p) in zip(got, rows, strict=False):
        assert r.p == pytest.approx(p, rel=0.05 if p < 1e-6 else 1e-6, abs=1e-8) or df > 10**6
    assert [r.p for r in got[-2:]] == [None, None]


def test_checkers_find_what_is_broken(spark):
    found = registry.queries()["fold_violations"](spark, D).collect()
    kinds = {}
    for r in found:
        kinds.setdefault(r.case, set()).add(r.rule)
    assert "good" not in kinds and "lost" in kinds["lost"] and "twice" in kinds["twice"] and "stray" in kinds["moved"]
    edges = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 1.0), ("m", "top", 1.0)], "from_tag string, to_tag string, weight double")
    tree = tree_fold.tour(edges, "top")
    sizes = spark.createDataFrame([("a", 3), ("b", 9), ("m", 5), ("top", 2)], "tag string, n long")
    rows = [(4, "a", "a"), (4, "b", "top"), (4, "b", "b"), (4, "m", "a"), (9, "a", "m"), (9, "b", "m"), (9, "m", "m"), (9, "top", "top")]
    got = splits.fold_violations(spark.createDataFrame(rows, "min_n long, tag string, cat string"), tree, sizes)
    # at 4: top has no row, b two; m lies in a, which is below it; m holds songs and is no category, though a and b are
    assert sorted(map(tuple, got.collect())) == [(4, "lost", "top"), (4, "parent", "a"), (4, "parent", "b"), (4, "stray", "m"), (4, "twice", "b")]


def test_gexf_of_any_labels(spark, tmp_path):
    tags = spark.createDataFrame([("a & b",), ("<c>",), ("d",)], "tag string")
    edges = spark.createDataFrame([("a & b", "<c>", 0.25), ("d", "d", 1.0)], "from_tag string, to_tag string, weight double")
    path = gexf.write_gexf(tags, edges, "g", str(tmp_path))
    vertices, back = gexf.read_gexf(spark, path)
    assert {r.tag for r in vertices.collect()} == {"a & b", "<c>", "d"} and {tuple(r) for r in back.collect()} == {("a & b", "<c>", 0.25), ("d", "d", 1.0)}


def test_arrow_files(spark, tmp_path):
    rows = [(1, ["x", None], {"k": 2}), (2, [], None), (3, None, {})]
    df = spark.createDataFrame(rows, "id long, `a list.of names` array<string>, m map<string,int>").repartition(3)
    for _ in range(2):
        arrow_files.write_arrow(df, str(tmp_path / "t"))
    back = arrow_files.read_arrow(spark, str(tmp_path / "t"))
    assert back.columns == df.columns and back.rdd.getNumPartitions() > 1
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows * 2, key=str)
    assert arrow_files.read_arrow(spark, str(tmp_path / "t"), "id long").count() == 6


def test_empty_lines(spark):
    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in ("part", "orders"):
        shutil.copy(f"{D}/{name}.parquet", d)
    inputs.table(spark, D, "lineitem").limit(0).write.parquet(f"{d}/lineitem.parquet")
    for name in ("k_categories", "hierarchy_level", "descendants", "tree_fold_grid", "tree_fold_solutions", "genealogy", "tag_hierarchy", "fold_violations", "without_cycles", "median_max_prob"):
        rows = registry.queries()[name](spark, d).collect()
        assert [r for r in rows if any(v is not None for v in r)] == [], name


def test_random_folds_have_no_violations(spark):
    pick = random.Random(2)
    parent = [(f"t{k:02d}", f"t{pick.randrange(k):02d}", 1.0) for k in range(1, 20)]
    sizes = spark.createDataFrame([(f"t{k:02d}", pick.choice([1, 2, 5, 9])) for k in range(20)], "tag string, n long")
    tree = tree_fold.tour(spark.createDataFrame(parent, "from_tag string, to_tag string, weight double"), "t00")
    folds = tree_fold.fold_trees(tree_fold.sized(tree, sizes), [2, 6, 12]).select("min_n", "tag", "cat")
    assert splits.fold_violations(folds, tree, sizes).collect() == []
    assert splits.fold_violations(splits.broken_folds(folds).where("case = 'unfolded'").drop("case"), tree, sizes).select("rule").distinct().collect() == [("small",)]
