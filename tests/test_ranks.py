import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tagloom.functions import ranks

SHARES = [0.0, 0.1, 1 / 3, 0.5, 0.66, 0.999, 1.0]


def frame(spark, values):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], "x double").repartition(3)


@pytest.mark.parametrize("few", [4, 50, 4096])
@pytest.mark.parametrize("kind", ["even", "skewed", "equal", "negative"])
def test_quantiles_as_numpy_has_them(spark, monkeypatch, few, kind):
    monkeypatch.setattr(ranks, "FEW", few)
    pick = np.random.default_rng(few)
    x = {"even": pick.random(700), "skewed": 10.0 ** pick.uniform(-20, 20, 700), "equal": np.repeat([2.0, 7.0, 7.5], [400, 250, 50]), "negative": -np.round(pick.exponential(3, 700), 1)}[kind]
    shares = SHARES if few > 4 else [0.1, 0.5]
    got = ranks.quantiles(frame(spark, x), "x", shares)
    assert got == pytest.approx(np.quantile(x, shares).tolist(), rel=1e-12)


def test_nulls_and_no_values(spark):
    assert ranks.quantiles(frame(spark, [None, 3, None, 1]), "x", [0.5]) == [2.0]
    assert ranks.quantiles(frame(spark, [None]), "x", [0.5, 1.0]) == [None, None]
    assert ranks.quantiles(frame(spark, [5]), "x", SHARES) == [5.0] * len(SHARES)


def test_places_and_sums(spark, monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 7)
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("v")).unionByName(spark.range(30).select(F.lit(41).alias("v")))
    got = ranks.sums_before(ranks.placed(rows, ["v"]), "place", "v").orderBy("place").collect()
    values = sorted([*range(100), *[41] * 30])
    assert [r.v for r in got] == values and [r.place for r in got] == list(range(1, 131))
    assert [r.before for r in got] == [sum(values[:k]) for k in range(130)]


def test_sketch_bounds_are_checked(spark):
    low, high, below, within = ranks._halved(frame(spark, [1, 2, 2, 2, 9]), "x", 4)
    assert (low, high, below, within) == (9.0, 9.0, 4, 1) and math.isfinite(low)
