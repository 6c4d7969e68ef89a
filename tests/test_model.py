"""The hand-computed five-track example, and what must hold for any fold."""

import math
import random
from fractions import Fraction as Q

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import stats
from tagloom.operators import assign, compare, dag, fold, inspect, votes

VOTES = [(1, "rock", 2), (1, "pop", 2), (2, "rock", 1), (3, "metal", 1), (3, "rock", 1), (4, "metal", 1), (4, "rock", 2), (4, "pop", 1), (5, "pop", 3), (5, "metal", 1)]


def table(spark, rows):
    return spark.createDataFrame([(t, g, float(v)) for t, g, v in rows], "track int, tag string, votes double")


@pytest.fixture(scope="module")
def p(spark):
    return votes.normalized(table(spark, VOTES)).cache()


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys[:-1]): r[keys[-1]] for r in df.collect()}


def test_marginals_and_joint(p):
    assert {k[0]: round(v, 9) for k, v in as_dict(votes.marginals(p), "tag", "marginal").items()} == {"metal": 0.2, "pop": 0.3, "rock": 0.5}
    got = as_dict(votes.joint(p), "a", "b", "joint")
    for pair, want in {("metal", "pop"): Q(1, 20), ("metal", "rock"): Q(3, 40), ("pop", "rock"): Q(3, 40)}.items():
        assert got[pair] == pytest.approx(float(want)) and got[pair[::-1]] == got[pair]


def test_conditional_and_generality(p):
    got = as_dict(votes.conditional(p), "a", "b", "w")
    want = {("metal", "pop"): 1 / 4, ("metal", "rock"): 3 / 8, ("pop", "metal"): 1 / 6, ("pop", "rock"): 1 / 4, ("rock", "metal"): 3 / 20, ("rock", "pop"): 3 / 20}
    assert got == pytest.approx(want)
    assert as_dict(votes.generality(p), "tag", "generality") == pytest.approx({("metal",): 19 / 60, ("pop",): 2 / 5, ("rock",): 5 / 8})


def test_graph(p):
    edges = dag.edges(p)
    assert as_dict(edges, "from_tag", "to_tag", "weight") == pytest.approx({("metal", "pop"): 1 / 4, ("metal", "rock"): 3 / 8, ("pop", "rock"): 1 / 4})
    assert [r.tag for r in dag.roots(p.select("tag").distinct(), edges).collect()] == ["rock"]
    assert as_dict(dag.parent_weights(edges), "child", "parent", "w") == pytest.approx({("metal", "pop"): 2 / 5, ("metal", "rock"): 3 / 5, ("pop", "rock"): 1})


def test_fold(p):
    state = fold.fold(p, dag.edges(p))
    assert state.order == ["metal", "pop"] and state.roots == ["rock"]
    assert state.sizes == [{"metal": 1, "pop": 2, "rock": 2}, {"metal": 0, "pop": 2, "rock": 3}, {"metal": 0, "pop": 0, "rock": 5}]
    assert state.ginis[:2] == pytest.approx([0.2, 0.2]) and math.isnan(state.ginis[2])


def test_fold_probabilities(spark, p):
    state = fold.fold(p, dag.edges(p))
    q = assign.probabilities(p, fold.mapping_table(spark, state, 2))
    got = as_dict(q, "track", "cat", "p")
    assert got == pytest.approx({(1, "pop"): 1 / 2, (1, "rock"): 1 / 2, (2, "rock"): 1, (3, "pop"): 1 / 5, (3, "rock"): 4 / 5, (4, "pop"): 7 / 20, (4, "rock"): 13 / 20, (5, "pop"): 17 / 20, (5, "rock"): 3 / 20})
    assert {r.track: r["cat"] for r in assign.wide_map(q, ["pop", "rock"]).collect()} == {1: "pop", 2: "rock", 3: "rock", 4: "rock", 5: "pop"}
    with pytest.raises(ValueError):
        state.folded(0)


def test_two_tie_rules(spark):
    rows = [(t, "a", 1) for t in range(1, 6)] + [(1, "b", 1), (9, "b", 1)]
    p = votes.normalized(table(spark, rows))
    q = p.withColumnRenamed("tag", "cat")
    sizes = as_dict(assign.hard_sizes(q, assign.rarity(p), q.select("cat").distinct()), "cat", "n")
    assert sizes == {("a",): 4, ("b",): 2}
    assert {r.track: r["cat"] for r in assign.labels(q).collect()}[1] == "a"


def random_votes(pick, tags=9, tracks=60):
    rows = []
    for t in range(tracks):
        for g in pick.sample(range(tags), pick.randint(1, 4)):
            rows.append((t, f"g{g}", pick.randint(0, 4)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_fold_invariants(spark, seed):
    p = votes.normalized(table(spark, random_votes(random.Random(seed)))).where("p > 0").cache()
    graph = dag.edges(p)
    state = fold.fold(p, graph)
    assert sorted([*state.order, *state.roots]) == state.tags
    assert all(sum(s.values()) == p.select("track").distinct().count() for s in state.sizes)
    for k in range(len(state.roots), len(state.tags) + 1):
        mapping = state.mapping(state.folded(k))
        mass = {}
        for tag, _, w in mapping:
            mass[tag] = mass.get(tag, 0) + w
        assert len({c for _, c, _ in mapping} - set(state.folded(k))) <= k and mass == pytest.approx(dict.fromkeys(state.tags, 1.0))
    # whatever the order, the set of folded tags decides the mapping
    some = state.order[: len(state.order) // 2]
    paths = {(r.tag, r["cat"]): r.w for r in fold.paths_mapping(dag.parent_weights(graph), p.select("tag").distinct(), some).collect()}
    assert paths == pytest.approx({(t, c): w for t, c, w in state.mapping(some[::-1])})
    left = state.graph(some)
    shares = {}
    for child, _, w in left:
        shares[child] = shares.get(child, 0) + w
    assert not {t for a, b, _ in left for t in (a, b)} & set(some) and shares == pytest.approx(dict.fromkeys(shares, 1.0))


def test_the_index_may_be_cut_in_any_way(spark, monkeypatch):
    p = votes.normalized(table(spark, random_votes(random.Random(8), 6, 40))).where("p > 0").cache()
    graph = dag.edges(p)
    one = fold.fold(p, graph)
    monkeypatch.setattr(fold, "FILE_ROWS", 3)
    two = fold.fold(p, graph, groups=2)
    assert (one.order, one.sizes) == (two.order, two.sizes)
    # dense and sorted blocks have one winner
    pick = np.random.default_rng(1)
    row = np.repeat(np.arange(50), 3)
    tag, share = pick.integers(0, 6, 150), pick.choice([0.25, 0.5, 1 / 3], 150)
    mapping = fold.Mapping([(np.array([i, (i + 1) % 6]), np.array([0.5, 0.5])) for i in range(6)])
    rank = pick.permutation(6)
    dense = fold.winners(tag, share, row, mapping, rank)
    monkeypatch.setattr(fold, "MOST_CELLS", -1)
    assert dense.tolist() == fold.winners(tag, share, row, mapping, rank).tolist()
    given = fold.fold(p, graph, one.order[::-1])
    assert given.order == one.order[::-1]


def test_a_step_reads_the_touched_tags_only(spark):
    pick = random.Random(3)
    rows = [(t, f"g{g:03d}", pick.randint(1, 4)) for t in range(300) for g in pick.sample(range(150), pick.randint(1, 4))]
    p = votes.normalized(table(spark, rows)).cache()
    tags = sorted({g for _, g, _ in rows})
    index = fold.profile_index(p, tags, {}, groups=16)
    vectors = {tuple((tags.index(g), v) for _, g, v in sorted(r for r in rows if r[0] == t)) for t in range(300)}
    read = lambda some: fold.touched_rows(index, some, groups=16)
    for some in ([5], [5, 21], [0, 77, 149]):
        files = {r.p for r in read(some).select("_metadata.file_path").distinct().toDF("p").collect()}
        assert {int(f.split("grp=")[1].split("/")[0]) for f in files} == {t % 16 for t in some}
        found = read(some).collect()
        # a row for each of the touched tags that a profile holds, and no other
        assert sum(r.n for r in found) == len([g for _, g, _ in rows if tags.index(g) in some])
        assert all(r.t in some for r in found) and len(found) <= len(vectors) * len(some)
        once = fold.first_rows(index, some, groups=16).collect()
        assert len({(r.t, str(r.v)) for r in once}) == len({str(r.v) for r in once}) == len({str(r.v) for r in found})


def test_a_step_reads_a_profile_once(spark, monkeypatch):
    """Frequent tags are met in the table of profiles, rare ones in the index; both ways give one fold."""
    p = votes.normalized(table(spark, random_votes(random.Random(9), 6, 80))).where("p > 0").cache()
    graph = dag.edges(p)
    vectors = {}
    for r in p.collect():
        vectors.setdefault(r.track, set()).add((r.tag, r.p))
    different = len({frozenset(v) for v in vectors.values()})
    made, read, change, stored = [], [], fold.change, fold.stored
    monkeypatch.setattr(fold, "stored", lambda df, name, **by: made.append(name) or stored(df, name, **by))
    monkeypatch.setattr(fold, "change", lambda rows, *state: read.append(rows.count()) or change(rows, *state))
    one = fold.fold(p, graph)
    assert made == ["fold-profiles"] and {*read} == {different} and len(read) == len(one.order) + 1
    made.clear()
    monkeypatch.setattr(fold, "INDEX_COST", 0)
    two = fold.fold(p, graph, rows=votes.by_track(p))
    assert made == ["fold-profiles", "fold-index"] and (one.order, one.sizes) == (two.order, two.sizes)


def test_a_frequent_profile_is_counted_before_it_is_dealt(spark):
    p = spark.range(1000).select(F.col("id").alias("track"), F.lit("g").alias("tag"), F.lit(1.0).alias("p")).repartition(2)
    rows = p.unionByName(p.select("track", F.lit("absent").alias("tag"), F.lit(0.0).alias("p"))).groupBy("track").agg(F.collect_list(F.struct("tag", "p")).alias("v")).coalesce(1)
    counted = rows.select("v").mapInArrow(fold._vectors(["absent", "g"]), "v binary, n long").collect()
    assert [(np.frombuffer(r.v, fold.ENTRY).tolist(), r.n) for r in counted] == [([(1, 1.0)], 1000)]


def test_tags_by_the_hundred(spark):
    """150 tags that meet, more pairs than any small table."""
    import shutil
    import tempfile

    from tagloom.plans import inputs, registry

    d = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    for name in ("lineitem", "orders"):
        shutil.copy(f"/root/testdata/sf0.001/{name}.parquet", d)
    part = inputs.table(spark, "/root/testdata/sf0.001", "part")
    part.withColumn("p_type", F.concat(F.lit("t"), F.col("p_partkey") % 150)).write.parquet(f"{d}/part.parquet")
    for name in ("track_label", "jsd_columns", "long_with_labels"):
        assert registry.queries()[name](spark, d).count() > 0


def test_ties_fold_by_the_definition_of_each_state(spark):
    """Thirds and sixths, whose sums tie with other shares."""
    pick = random.Random(5)
    rows = [(t, f"g{g}", v) for t in range(60) for g, v in zip(pick.sample(range(7), 3), pick.choice([(1, 1, 1), (2, 2, 2), (3, 2, 1), (1, 1, 2)]), strict=True)]
    p = votes.normalized(table(spark, rows)).cache()
    graph = dag.edges(p)
    one = fold.fold(p, graph)
    assert len(one.order) > 3
    # each state as its own definition has it
    for k in range(len(one.order) + 1):
        q = assign.probabilities(p, spark.createDataFrame(one.mapping(one.order[:k]), "tag string, cat string, w double"))
        sizes = as_dict(assign.hard_sizes(q, assign.rarity(p), spark.createDataFrame([(t,) for t in one.tags], "cat string")), "cat", "n")
        assert {c: n for (c,), n in sizes.items()} == one.sizes[k]


def test_the_graph_has_no_cycle(spark):
    p = votes.normalized(table(spark, random_votes(random.Random(4), 12, 80))).where("p > 0")
    g = as_dict(votes.generality(p), "tag", "generality")
    assert all(g[(r.from_tag,)] < g[(r.to_tag,)] for r in dag.edges(p).collect())


def test_zero_votes_and_empty_tables(spark):
    p = votes.normalized(table(spark, [(1, "a", 0), (1, "b", 0), (2, "a", 1)]))
    assert [(r.track, r.tag, r.p) for r in p.collect()] == [(2, "a", 1.0)]
    empty = votes.normalized(table(spark, []))
    assert dag.edges(empty).count() == 0 and votes.marginals(empty).count() == 0
    assert fold.fold(empty, dag.edges(empty)).order == []


def dense_spearman(a, b):
    def ranks(x):
        order = np.argsort(x, kind="stable")
        r = np.empty(len(x))
        r[order] = np.arange(len(x))
        return np.array([r[x == v].mean() for v in x])

    return np.corrcoef(ranks(a), ranks(b))[0, 1]


def test_spearman_counts_absent_as_zero(spark):
    pick = np.random.default_rng(2)
    x, y = (pick.integers(0, 4, (30, 3)) * (pick.random((30, 3)) < 0.6) for _ in range(2))
    x[:, 2] += 1  # a column without zeros
    long = lambda m: spark.createDataFrame([(int(t), str(c), float(m[t, c])) for t in range(30) for c in range(3) if m[t, c] or c == 2], "track int, cat string, p double")
    got = as_dict(stats.spearman_block(long(x), long(y)), "a", "b", "corr")
    for a in range(3):
        for b in range(3):
            assert got[str(a), str(b)] == pytest.approx(dense_spearman(x[:, a], y[:, b]))


def test_divergence(spark):
    m = lambda rows: spark.createDataFrame(rows, "tag string, cat string, w double")
    first = m([("x", "1", 1.0), ("y", "1", 1.0), ("z", "1", 1.0)])
    second = m([("x", "2", 1.0), ("y", "1", 1.0), ("z", "1", 0.5), ("z", "2", 0.5)])
    got = as_dict(stats.jensen_shannon(first, second), "tag", "jsd")
    assert got == pytest.approx({("x",): 1.0, ("y",): 0.0, ("z",): 1.5 - 0.75 * math.log2(3)})


def test_f1_leaves_out_classes_that_the_truth_lacks(spark):
    pairs = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", "c")], "truth string, guess string")
    assert stats.macro_f1(pairs).first()[0] == pytest.approx((2 / 3 + 1 / 2) / 2)


def test_gini(spark):
    values = spark.createDataFrame([(1.0,), (2.0,), (2.0,)], "n double")
    assert stats.gini(values, "n").first()[0] == pytest.approx(0.2) == stats.gini_of([1, 2, 2])
    assert math.isnan(stats.gini_of([5])) and stats.gini(values.limit(1), "n").first()[0] is None


def test_robustness_of_equal_mappings(spark, p):
    mapping = fold.mapping_table(spark, fold.fold(p, dag.edges(p)), 2)
    got = compare.robustness(p, mapping, mapping)
    assert got["f1"].first()[0] == 1.0 and {r.jsd for r in got["divergence"].collect()} == {0.0}
    assert got["test"].first()["mean"] == 0.0


def test_examples_and_solution(spark):
    rows = [(1, "A", "x", 0.9, 1.0), (2, "A", "x", 0.95, 0.0), (3, "B", "x", 0.9, 5.0), (4, "C", "x", 0.9, 7.0), (5, "D", "x", 1.0, 0.0)]
    labelled = spark.createDataFrame(rows, "track int, artist string, cat string, cat_prob double, popularity double")
    assert [r.track for r in inspect.example_tracks(labelled, 2, mixed_only=True).orderBy("place").collect()] == [2, 4]
    assert [r.track for r in inspect.example_tracks(labelled, 1).collect()] == [5]
    sizes = spark.createDataFrame([("a", 0), ("b", 3), ("c", 5)], "cat string, n long")
    graph = spark.createDataFrame([("a", "b", 0.3), ("b", "c", 0.2)], "from_tag string, to_tag string, weight double")
    top, pruned = inspect.solution(sizes, graph)
    assert [r["cat"] for r in top.collect()] == ["c", "b"] and pruned.count() == 1
