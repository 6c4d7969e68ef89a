"""What a task of a shuffle holds is bounded: partitions follow the rows of the input."""

import re

import pytest
from pyspark.sql import functions as F

from tagloom.functions import stats
from tagloom.operators import fold, metagenres, votes
from tagloom.plans import catalog, inputs, registry
from tagloom.sources import sizes

D = "/root/testdata/sf0.001"  # 6,000 lines


@pytest.fixture
def small_tasks(monkeypatch):
    monkeypatch.setattr(sizes, "TASK_ROWS", 300)


def fullest(df, key="track"):
    """Partitions, and the most keys of any."""
    n = df.select(F.spark_partition_id().alias("part"), key).distinct().groupBy("part").count().collect()
    return df.rdd.getNumPartitions(), max(r["count"] for r in n)


@pytest.mark.parametrize("lookup", [1_000_000, 10])
def test_shares_and_votes_follow_the_rows(spark, small_tasks, monkeypatch, lookup):
    monkeypatch.setattr(sizes, "MOST_LOOKUP", lookup)
    for df in (inputs.shares(spark, D), inputs.votes_long(spark, D)):
        parts, most = fullest(df)
        assert parts == 20 and most < 200


def test_shares_are_the_same_in_any_partitions(spark, monkeypatch):
    rows = lambda: sorted((r.track, r.tag, round(r.p, 12)) for r in inputs.shares(spark, D).collect())
    plain = rows()
    monkeypatch.setattr(sizes, "TASK_ROWS", 300)
    monkeypatch.setattr(sizes, "MOST_LOOKUP", 10)
    assert rows() == plain


@pytest.mark.parametrize("name", ["metagenre_prevalences", "hard_class_tie", "metagenre_map", "vote_matrix_wide", "nested_artist_union"])
def test_queries_by_track_keep_their_partitions(spark, small_tasks, name):
    parts, most = fullest(registry.queries()[name](spark, D))
    assert parts == 20 and most < 200


def by_track(df):
    """Partitions of a plan's shuffles by track."""
    return re.findall(r"hashpartitioning\(track#\d+L?, (\d+)\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.mark.parametrize("name", ["gini_sizes", "hard_sizes", "tag_marginals", "tag_rarity", "conditional", "dag_edges", "generality", "joint", "parent_weights"])
def test_queries_on_shares_shuffle_tracks_by_their_rows(spark, small_tasks, name):
    assert {*by_track(registry.queries()[name](spark, D))} == {"20"}


def test_stored_votes_are_not_shuffled_by_track_again(spark, small_tasks):
    types = catalog._Types(spark, D)
    assert by_track(votes.conditional(types.p, types.rows)) == []
    plain = lambda df: sorted((r.a, r.b, round(r.w, 12)) for r in df.collect())
    assert plain(votes.conditional(types.p, types.rows)) == plain(votes.conditional(inputs.shares(spark, D, "p_type")))
    tags = sorted(r.tag for r in types.tags.collect())
    rare = {r.tag: r["count"] for r in types.p.groupBy("tag").count().collect()}
    found = fold.profiles(types.rows, tags, rare)
    parts = found.groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) > 10 and max(r["count"] for r in parts) < 300


def test_artists_beyond_the_broadcast_bound(spark, small_tasks, monkeypatch):
    want = sorted(map(tuple, registry.queries()["nested_artist_union"](spark, D).collect()))
    monkeypatch.setattr(sizes, "MOST_LOOKUP", 2)
    df = registry.queries()["nested_artist_union"](spark, D)
    assert df.rdd.getNumPartitions() == 20 and sorted(map(tuple, df.collect())) == want


def test_a_class_of_no_metagenre(spark):
    long = spark.createDataFrame([(1, "a", 2.0), (1, "c", 5.0), (2, "c", 1.0), (None, "a", 1.0)], "track int, tag string, votes double")
    mapping = spark.createDataFrame([("a", "x"), ("c", None)], "tag string, metagenre string")
    got = metagenres.mapped(long, mapping, ["x", "y"])
    assert got.columns == ["track", "p_x", "p_y", "n_x", "n_y", "n_max", "p_max", "metagenre"]
    assert [tuple(r) for r in got.collect()] == [(1, pytest.approx(2 / 7), 0.0, 2.0, 0.0, 5.0, pytest.approx(5 / 7), "x")]


def test_rank_correlation_shuffles_tracks_once(spark, monkeypatch):
    """Ranks come to a track's row, by a broadcast up to a bound and by shuffles beyond, with the same result."""
    first, second = (inputs.shares(spark, D, t).withColumnRenamed("tag", "cat") for t in ("p_type", "p_brand"))
    sides = stats.side_by_side(first, second)
    few = stats.spearman_cells(sides)
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [track" not in plan and "SortMergeJoin [cat" not in plan
    monkeypatch.setattr(stats, "MOST_VALUES", 0)
    monkeypatch.setattr(sizes, "TASK_ROWS", 300)
    key = lambda r: (r.a, r.b)
    many = sorted(stats.spearman_cells(sides).collect(), key=key)
    assert len(many) == 150 and [r.corr for r in sorted(few.collect(), key=key)] == pytest.approx([r.corr for r in many])
