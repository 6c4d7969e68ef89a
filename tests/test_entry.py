"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as entry
from tagloom.plans import registry

duckdb = pytest.importorskip("duckdb")
D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    con = duckdb.connect()
    for name in os.listdir(D):
        con.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{D}/{name}')")
    return con


def plain(rows):
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(map(value, r)) for r in rows), key=str)


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_same_rows_as_sql(spark, database, name):
    got = registry.queries()[name](spark, D)
    columns = sorted(got.columns)
    want = database.sql(registry.oracle_sql()[name])
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert plain(got.select(columns).collect()) == plain([tuple(r[i] for i in order) for r in want.fetchall()])


def plain_tree_fold(parent, sizes, least):
    """tag -> category by the rule alone: the deepest category under `least` goes up with its whole family, until none is left."""
    depth = lambda t: 0 if t not in parent else 1 + depth(parent[t])
    above = lambda t: [t, *above(parent[t])] if t in parent else [t]
    now, done = {t: t for t in sizes}, set()
    while True:
        count = {c: sum(sizes[t] for t in now if now[t] == c) for c in set(now.values())}
        open_ = [c for c in count if count[c] and c not in done]
        if not open_:
            return now, count
        c = min(open_, key=lambda t: (-depth(t), t))
        if c not in parent or count[c] >= least:
            done.add(c)
            continue
        up = parent[c]
        family = {t for t in [*parent, *sizes] if up in above(t)[1:]}
        now = {t: up if x in family else x for t, x in now.items()}
        done |= family


def test_tree_folds_of_the_registered_tables(spark, database):
    """The two queries, against the rule applied to a tree and sizes that come from SQL."""
    tree = dict(database.sql("with t as (" + registry.oracle_sql()["strongest_parent"] + ") select a, b from t").fetchall())
    sizes = dict(database.sql("select p_type, count(distinct l_orderkey) from lineitem join part on p_partkey = l_partkey group by 1").fetchall())
    grid = [(r.min_n, r.n_metagenres, r.weighted_gini) for r in registry.queries()["tree_fold_grid"](spark, D).collect()]
    mapped = {}
    for r in registry.queries()["tree_fold_solutions"](spark, D).collect():
        mapped.setdefault(r.min_n, {})[r.tag] = r["cat"]
    assert len(grid) > 3 and sorted(mapped) == sorted(n for n, *_ in grid)
    depth = lambda t: 0 if t not in tree else 1 + depth(tree[t])
    for least, categories, gini in grid:
        want, count = plain_tree_fold(tree, sizes, least)
        assert mapped[least] == want and categories == len(count)
        # the Lorenz curve of the sizes, each weighted by its level plus one
        points, x, y = [(0.0, 0.0)], 0.0, 0.0
        for n, w in sorted((n, depth(c) + 1) for c, n in count.items()):
            x, y = x + w, y + n * w
            points.append((x, y))
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:], strict=False)) / (x * y)
        assert gini == pytest.approx(max(0.0, 1 - 2 * area))
    assert {*registry.queries()} == {*registry.oracle_sql()}


def test_contract(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
