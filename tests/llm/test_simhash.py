import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tagloom.llm.components import components


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """rows (doc_id, fp) -> {(doc_id, fp): least doc_id reachable}; all pairs of fingerprints."""
    fps = sorted({f for _, f in rows})
    up = {f: f for f in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(fps):
        for b in fps[k + 1 :]:
            if (a ^ b).bit_count() <= 3:
                up[root(a)] = root(b)
    least = {}
    for d, f in rows:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return {(d, f): least.get(root(f)) for d, f in rows}


@pytest.mark.parametrize("table", ["awkward", "tiny"])
def test_against_brute_force(spark, request, table):
    docs = request.getfixturevalue(table)
    rows = [(r.doc_id, plain_fingerprint(r.text)) for r in docs.collect()]
    want = plain_components(rows)
    got = [(r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted(((d, f, want[d, f]) for d, f in rows), key=str)


def family(pick, n, spread):
    """n distinct fingerprints that drift from one start, a few bits at a time."""
    out = {pick.integers(0, 1 << 63)}
    while len(out) < n:
        x = int(pick.choice(sorted(int(v) for v in out)[-spread:]))
        for b in pick.integers(0, 63, pick.integers(1, 5)):
            x ^= 1 << int(b)
        out.add(x)
    return [int(x) for x in out]


@pytest.mark.parametrize("tile", [simhash.TILE, 8])
def test_links_of_many_fingerprints(spark, tile):
    """Random ones and families; with a small tile, large blocks are cut."""
    pick = np.random.default_rng(4)
    fps = sorted({*family(pick, 150, 5), *family(pick, 80, 80), *(int(x) for x in pick.integers(0, 1 << 63, 300))})
    nodes = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(nodes, tile=tile)).collect()}
    want = plain_components([(k, f) for k, f in enumerate(fps)])
    for k, f in enumerate(fps):
        assert fps.index(roots.get(f, f)) == want[k, f]


def test_within_counts_every_distance():
    pick = np.random.default_rng(0)
    a = pick.integers(0, 1 << 63, 5000).astype(np.uint64)
    b = a.copy()
    for k in range(len(b)):
        for j in pick.choice(64, k % 9, replace=False):
            b[k] ^= np.uint64(1 << int(j))
    alive = pick.integers(0, 2, 5000).astype(np.uint8)
    hits = simhash._set_bits(simhash.within(simhash.bit_planes(a), simhash.bit_planes(b), simhash._pack(alive)))
    assert hits.tolist() == [k for k in range(5000) if alive[k] and k % 9 <= 3]


def test_drop_keeps_one_of_each(spark, tiny, tmp_path):
    tiny.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    found = simhash.near_duplicates(docs)
    kept = {r.doc_id for r in simhash.drop_near_duplicates(docs).collect()}
    assert kept == {r.component_id for r in found.select("component_id").distinct().collect()}


def test_chain_is_one_component(spark):
    edges = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.root for r in components(edges).collect()} == {0}


def test_empty(spark, nothing):
    assert simhash.near_duplicates(nothing).count() == 0
