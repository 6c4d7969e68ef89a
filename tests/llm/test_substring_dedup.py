import gc
import random
import weakref
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tagloom.llm import substring_dedup as sd
from tagloom.llm.common import split_words


def brute(texts, n=sd.WINDOW):
    docs = [split_words(t) for t in texts]
    seen = Counter(tuple(w[k : k + n]) for w in docs for k in range(len(w) - n + 1))
    out = []
    for w in docs:
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] > 1:
                gone.update(range(k, k + n))
        out.append((len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def mixed(seed):
    """Documents that share passages of 20 to 120 words at all offsets, copies, and runs of one word."""
    pick = random.Random(seed)
    fresh = lambda n: [f"w{pick.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(n) for n in (20, 34, 35, 36, 37, 53, 70, 120)]
    texts = []
    for _ in range(40):
        words = fresh(pick.randrange(40))
        for _ in range(pick.randrange(4)):
            words += pick.choice(shared) + fresh(pick.randrange(30))
        texts.append(" ".join(words))
    return [*texts, texts[3], "", None, "x " * 36, "x " * 35, "y " * 34, "z z z", " ".join(shared[7] * 3)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    texts = mixed(seed)
    docs = spark.createDataFrame([(k, t, "c", 1) for k, t in enumerate(texts)], "doc_id long, text string, row string, spans int").coalesce(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.without_repeats(docs).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


@pytest.mark.parametrize("chunk_words", [1, 50, 400])
def test_small_chunks(spark, chunk_words):
    """Repeats within a chunk and across chunks, down to one document a chunk."""
    texts = mixed(7)
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in sd.without_repeats(docs, chunk_words, seed=3).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts)


def arrow(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema, strict=True)], names=[f"c{k}" for k in range(len(schema))])


def test_a_passage_of_most_documents_stays_in_its_chunks():
    """A hash range gets a common block or window once a chunk, however many documents hold it."""
    pick = random.Random(5)
    shared = " ".join(f"s{k}" for k in range(60))
    texts = [(k, f"{' '.join(f'w{pick.randrange(10**9)}' for _ in range(k % 18))} {shared} t{k}") for k in range(900)]
    batch = arrow(texts, [pa.int64(), pa.string()])
    sent = [r for b in sd.send_anchors(4, chunk_words=9000)([batch]) for r in b.to_pylist()]
    chunks = -(-sum(len(t.split()) for _, t in texts) // 9000)
    keys = Counter()
    for r in sent:
        if r["probes"]:
            keys.update((r["bucket"], x) for x in np.cumsum(sd.unsqueezed(r["blocks"], np.uint32), dtype=np.uint32).tolist())
    assert max(keys.values(), default=0) <= chunks and sum(keys.values()) < 1000
    hits = Counter(row for b in sd.hit_blocks([arrow([tuple(r.values()) for r in sent], [pa.int32(), *[pa.binary()] * 5]).rename_columns(list(sent[0]))]) for row in b.column(0).to_pylist())
    assert set(hits) == set(range(900))
    around = arrow([(k, t, list(range(4))) for k, t in texts], [pa.int64(), pa.string(), pa.list_(pa.int32())])
    windows = [r for b in sd.send_windows(4, chunk_words=9000)([around]) for r in b.to_pylist()]
    assert max(len(sd.unsqueezed(r["rows"], np.int64)) for r in windows if r["a"]) < 400
    assert sum(len(sd.unsqueezed(r["rows"], np.int64)) for r in windows if not r["a"]) >= 900 * 26


def test_hashes_alone_remove_nothing(monkeypatch):
    """Where different windows have one hash, there is an error and no removal."""
    monkeypatch.setattr(sd, "rolled", lambda words, n, base: np.zeros(max(0, len(words) - n + 1), np.uint64))
    texts = arrow([(1, " ".join(f"a{k}" for k in range(40)), [0]), (2, " ".join(f"b{k}" for k in range(40)), [0])], [pa.int64(), pa.string(), pa.list_(pa.int32())])
    with pytest.raises(ValueError, match="another seed"):
        list(sd.send_windows(2)([texts]))
    words = "a b c d".split()
    assert sd.left_over(words, None, [{"lo": 1, "words": "b c"}]) == ["a", "d"]
    with pytest.raises(ValueError, match="another seed"):
        sd.left_over(words, None, [{"lo": 1, "words": "b x"}])


def test_awkward_and_empty(spark, awkward, nothing):
    texts = [r.text for r in awkward.collect()]
    got = sorted((r.n_words, r.n_removed, r.kept) for r in sd.without_repeats(awkward).collect())
    assert got == sorted(brute(texts))
    assert sd.without_repeats(nothing).count() == 0


def test_dropping_keeps_columns_and_clean_texts(spark, tmp_path):
    shared = " ".join(f"s{k}" for k in range(60))
    rows = [(1, f"a\nb {shared}", 0), (2, f"{shared}  c", 0), (3, "clean\n text", 11), (4, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "d"))
    got = sorted(tuple(r) for r in sd.drop_repeats(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert got == [(1, "a b", 3), (2, "c", 1), (3, "clean\n text", 11), (4, None, None)]


def test_packed_arrays_round_trip():
    for dtype in (np.uint32, np.uint64, np.int64):
        x = np.array([0, 1, 5, 2**31, 7], dtype)
        assert (sd.unsqueezed(sd.squeezed(x), dtype) == x).all()
    assert len(sd.unsqueezed(sd.squeezed(np.empty(0, np.uint32)), np.uint32)) == 0


@pytest.mark.parametrize("n", [1, 18, 35])
def test_rolled_hashes_hold_nothing_after_the_call(n):
    """Workers live on after a task: what only a collection of cycles would free adds up from task to task."""
    words = np.random.default_rng(0).integers(0, 1 << 63, 100, np.uint64)
    want, base, kept = [], int(sd.base(0, 0)), weakref.ref(words)
    for i in range(len(words) - n + 1):
        x = sum(int(w) * pow(base, n - 1 - j, 1 << 64) for j, w in enumerate(words[i : i + n])) % (1 << 64)
        x ^= x >> 32
        x = x * 0x9FB21C651E98DF25 % (1 << 64)
        want.append(x ^ x >> 29)
    gc.disable()
    try:
        assert sd.rolled(words, n, sd.base(0, 0)).tolist() == want
        del words
        assert kept() is None
    finally:
        gc.enable()
