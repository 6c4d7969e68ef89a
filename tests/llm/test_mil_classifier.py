import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from tagloom.llm import mil_classifier as mil

SF = "/root/testdata/sf0.01"


def test_gradients_are_those_of_the_loss():
    pick = np.random.default_rng(1)
    model = mil.Model(n=9)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, of, y, w = pick.standard_normal((7, 9)), np.array([0, 0, 0, 1, 2, 2, 2]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        s = model.score(x, of, 3)
        return -np.mean(w * (y * np.log(s) + (1 - y) * np.log(1 - s)))

    g = model.gradients(x, of, 3, y, w)
    for k, a in model.p.items():
        for at in [np.unravel_index(j, a.shape) for j in range(0, a.size, max(1, a.size // 5))]:
            old = a[at]
            a[at] = old + 1e-5
            up = loss()
            a[at] = old - 1e-5
            down = loss()
            a[at] = old
            assert g[k][at] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-6)


def test_held_out_accuracy(spark):
    got = {r.doc_id: r for r in mil.query(spark, SF).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for d, r in got.items())
    held = [(labels[d], r.predicted) for d, r in got.items() if r.held_out and d in labels]
    assert np.mean([y == p for y, p in held]) > 0.97


def test_training_leaves_out_the_held_out_fold(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    ids = [r.doc_id for r in mil.training_rows(docs, labels).collect()]
    assert ids and all(zlib.crc32(str(d).encode()) % 5 for d in ids)
    assert mil.training_rows(docs, labels, 10).count() <= 10


def plain_score(model, text):
    """A document's score passage by passage, from the definitions."""
    n = max(1, round(len(text) / mil.PASSAGE_BYTES))
    ends = [int(len(text) * k / n) for k in range(n + 1)]
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    runs = list(zip(words, words[1:], words[2:]))  # noqa: B905
    repeat = 1 - len(set(runs)) / max(1, len(runs)) if len(text) >= 64 else 0
    total, z = 0.0, np.zeros(mil.HIDDEN)
    for lo, hi in zip(ends, ends[1:], strict=False):
        x = [min(b, 127) for b in text[lo:hi]]
        size = max(1, len(x))
        one, two = Counter(x), Counter((a * 31 + b * 7) % 256 for a, b in zip(x, x[1:], strict=False))
        between = lambda a, b: sum(one[k] for k in range(a, b))  # noqa: B023, E731
        upper, lower = between(65, 91), between(97, 123) + one[127]
        ratios = [upper / (upper + lower + 1), between(48, 58) / size, 4 * (between(33, 48) + between(58, 65)) / size, 2 * sum(one[k] for k in (9, 10, 11, 12, 13, 32)) / size]
        ratios += [math.log1p(len(x)) / 8, repeat, math.log1p(n) / 4, float(not x)]
        row = np.array([2 * math.sqrt(one[k] / size) for k in range(128)] + [2 * math.sqrt(two[k] / size) for k in range(256)] + ratios)
        p = model.p
        h = np.tanh((row - model.mean) / model.scale @ p["E"] + p["e"])
        gate = np.tanh(h @ p["V"]) / (1 + np.exp(-(h @ p["U"])))
        weight = math.exp(float((gate @ p["w"])[0]))
        total, z = total + weight, z + weight * h
    return 1 / (1 + math.exp(-float((z / total @ model.p["o"] + model.p["b"])[0])))


def test_scores_against_the_definitions(spark, monkeypatch):
    """Every passage of every text counts, also where a text comes in many parts."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = mil.train(docs, labels)
    some = [(r.text or "").encode() for r in docs.limit(25).collect()]
    texts = [*some, b"", b"x", b"  ", "é 他".encode() * 300, b" ".join(some) + b"#$% " * 500, b"same three words " * 4000]
    assert mil.scores_of(model, texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-5)
    monkeypatch.setattr(mil, "PASSAGES_HELD", 8)
    assert mil.scores_of(model, texts) == pytest.approx([plain_score(model, t) for t in texts], abs=1e-4)


def test_memory_of_long_texts_is_bounded():
    model = mil.Model()

    def peak(n):
        text = b" ".join(b"w%d" % (k * 7919 % 100003) for k in range(n))
        tracemalloc.start()
        mil.scores_of(model, [text])
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    peak(1000)
    assert peak(1_600_000) < 1.5 * peak(200_000) + (16 << 20)


def test_repeats_of_long_texts():
    pick = np.random.default_rng(4)
    for different in (3000, 40_000):
        words = pick.integers(0, 10**9, different).astype(str)
        text = " ".join([*words, *words, *words]).encode()
        assert mil.repeat_share(np.frombuffer(text, np.uint8)) == pytest.approx(2 / 3, abs=0.02)


def test_long_texts_teach_too(spark):
    docs = spark.createDataFrame([(k, f"word{k} " * (20_000 if k % 2 else 3)) for k in range(12)] + [(1, "again")] * 9, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(12)], "doc_id long, quality int")
    rows = mil.training_rows(docs, labels).collect()
    texts = {(r.doc_id, bytes(r.passages).decode()) for r in rows}
    # whole texts, equal rows once
    assert texts == {(r.doc_id, r.text) for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5} and len(rows) == len(texts)
    assert len(mil.training_rows(docs, labels, 5).collect()) == 5
    size = lambda t: len(mil.passages(len(t))) - 1
    long = max(size(t) for _, t in texts)
    few = mil.training_rows(docs, labels, most_passages=2 * long + 10).collect()
    assert long > 200 and sum(size(r.passages) for r in few) <= 2 * long + 10 and sum(size(r.passages) > 100 for r in few) >= 2
    assert len([r for r in few if size(r.passages) == 1]) == len([t for _, t in texts if size(t) == 1])


def test_awkward_and_empty(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (8, 1), (9, None), (None, 1), (1, 1)], "doc_id long, quality int")
    out = mil.scored(awkward, mil.train(awkward, labels))
    assert out.columns == [*awkward.columns, "score"] and out.count() == awkward.count()
    model = mil.train(awkward, labels.limit(0))
    assert {r.score for r in mil.scored(awkward.withColumnRenamed("row", "score"), model).select("_score").toDF("score").collect()} == {0.5}
    assert mil.scored(nothing, model).count() == 0
