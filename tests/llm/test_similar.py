"""The pipeline's near-duplicates against all pairs of shingle sets."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from tagloom.llm import similar, simhash


def plain_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def plain_kept(rows):
    """Of rows (doc_id, text), the places of those kept: one of each component of pairs at 0.8 or more."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    best = {}
    for k, (d, _) in enumerate(rows):
        best.setdefault(root(k), []).append((d is None, d or 0, k))
    return {min(x)[2] for x in best.values()}


@pytest.mark.parametrize("table", ["awkward", "tiny"])
def test_stage_drops_what_is_alike(spark, request, table, tmp_path):
    request.getfixturevalue(table).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = plain_kept(rows)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(got, key=str) == sorted((rows[k] for k in kept), key=str)


@pytest.mark.parametrize("tile", [similar.TILE, 4])
def test_links_at_the_least_similarity(spark, tile, tmp_path):
    """Copies at 0.8 and a little less, and a chain of copies; with a small tile, components are cut."""
    pick, rows = random.Random(3), []
    for group in range(30):
        base = [f"w{pick.randrange(10**6)}" for _ in range(104)]
        for changed in (0, 2, 3, 1):  # of 100 shingles, 5 a word are others
            words = list(base)
            for k in range(changed):
                words[10 + 20 * k] = f"x{pick.randrange(10**6)}"
            rows.append((len(rows), " ".join(words)))
            base = words if group % 2 else base
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = similar.near_duplicates(docs, tile=tile).collect()
    first = {}
    for r in found:
        first[r.component] = min(r.doc_id, first.get(r.component, r.doc_id))
    kept = plain_kept(rows)
    assert set(first.values()) == {rows[k][0] for k in kept} and 30 < len(kept) < 120


def test_radius_holds_alike_sets():
    """Sets at 0.8 and above, small and large: their fingerprints lie within the radius."""
    pick, most = np.random.default_rng(6), 0
    for n in (4, 9, 18, 45, 90, 450, 3000):
        for _ in range(400):
            same, own = pick.integers(0, 1 << 63, n, np.uint64), pick.integers(0, 1 << 63, n // 4, np.uint64)
            cut = int(pick.integers(0, len(own) + 1))
            a, b = np.concatenate([same, own[:cut]]), np.concatenate([same, own[cut:]])
            assert similar.alike(np.sort(a), np.sort(b))
            most = max(most, (simhash.majority(a) ^ simhash.majority(b)).bit_count())
    assert 10 < most <= similar.RADIUS
