import pytest
from pyspark.sql import functions as F

from tagloom.operators import ingest, splits
from tagloom.plans import inputs, model

D = "/root/testdata/sf0.001"


def test_from_votes_to_robustness(spark):
    long = inputs.votes_long(spark, D, "p_type").withColumnsRenamed({"tag": "tag_name", "votes": "tag_count"})
    parts = model.halves(long, inputs.tracks(spark, D), least=5)
    artists = {k: {r.artist for r in v.select("artist").distinct().collect()} for k, v in parts.items()}
    assert not artists["train"] & artists["holdout"] and not artists["fold1"] & artists["fold2"]
    first = model.build(parts["fold1"])
    second = model.build(parts["fold2"], first.folding.order)
    holdout = model.build(parts["holdout"]).p
    k = max(2, len(first.folding.roots), len(second.folding.roots))
    got = model.robustness(first, second, k, holdout)
    assert 0 <= got["f1"].first()[0] <= 1 and got["divergence"].count() == 6
    assert first.labels(k, holdout).count() == holdout.select("track").distinct().count()


def test_nested_items_to_votes(spark):
    whitelist = spark.createDataFrame([("ECONOMY",), ("SMALL",), ("O",)], "tag_name string")
    got = model.long_votes(inputs.nested(spark, D), whitelist, whitelist.limit(0).union(spark.createDataFrame([("O",)], "tag_name string")))
    assert {r.tag_name for r in got.select("tag_name").distinct().collect()} == {"ECONOMY", "SMALL"}
    assert got.groupBy("track").agg(F.sum("tag_count").alias("n")).where("n < 2").count() == 0


def test_columns_by_pattern(spark):
    df = spark.createDataFrame([(1, 0.5, None, "x")], "id int, ab_rock double, ab_pop double, other string")
    assert ingest.matching(df, "^ab_", ("id",)).columns == ["id", "ab_rock", "ab_pop"]
    assert ingest.prefixed(df, "mb.", ("id",)).columns == ["id", "mb.ab_rock", "mb.ab_pop", "mb.other"]
    assert ingest.moved_first(df, ["other"]).columns[0] == "other"
    assert [tuple(r) for r in ingest.long_scores(df, ["id"], ["ab_rock", "ab_pop"], "ab_").collect()] == [(1, "rock", 0.5)]


def test_samples_and_constants(spark):
    rows = spark.range(1000).select("id", F.when(F.col("id") < 10, "rare").otherwise("often").alias("g"), F.lit("x").alias("c"))
    got = {r.g: r["count"] for r in splits.proportional_sample(rows, "g", "id", 100, least=5).groupBy("g").count().collect()}
    assert got == {"rare": 5, "often": 99}
    assert splits.constant_columns(rows, ["g", "c"]) == ["c"] and splits.without_constants(rows, ["g", "c"]).columns == ["id", "g"]


def test_split_table(spark):
    rows = spark.createDataFrame([(t, t % 4, "ab"[t % 2]) for t in range(40)], "track int, artist int, cat string")
    folds = splits.repeated_folds(rows, 3, 2, 5)
    assert folds.count() == 40 and folds.select("repeat").distinct().count() == 2
    one = splits.split_table(folds.where("repeat = 0"))
    assert {r.split_type for r in one.collect()} == {"train", "test"}
    n = folds.where("repeat = 0").select("fold").distinct().count()
    assert one.count() == 20 * n and one.where("split_type = 'test'").count() == 20
    assert splits.distribution(one).groupBy("split_type", "split_id").agg(F.sum("share").alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_external_tags(spark):
    ext = spark.createDataFrame([(t, a, g) for t, a, g in [(1, 1, "x"), (2, 2, "x"), (1, 1, "y"), (3, 3, "z")]], "track int, artist int, tag_name string")
    tracks = lambda *t: spark.createDataFrame([(x,) for x in t], "track int")
    assert {r.tag_name for r in splits.restricted(ext, tracks(1), tracks(2, 3), 1).collect()} == {"x"}


@pytest.mark.parametrize("tag", ["p_brand", "p_type"])
def test_plan_has_no_cartesian_product(spark, tag):
    from tagloom.operators import dag

    plan = dag.edges(inputs.shares(spark, D, tag))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_artist_union_reaches_every_order(spark):
    from tagloom.plans import registry

    union = registry.queries()["nested_artist_union"](spark, D)
    known = inputs.table(spark, D, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("l_suppkey"))
    want = inputs.table(spark, D, "lineitem").join(known, "l_suppkey", "left_semi").select(F.col("l_orderkey").alias("track")).distinct()
    assert union.select("track").distinct().exceptAll(want).isEmpty() and want.exceptAll(union.select("track").distinct()).isEmpty()
    assert not want.where("track % 3 > 0").isEmpty()
