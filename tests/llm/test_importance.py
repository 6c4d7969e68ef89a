import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tagloom.llm import importance


def plain_features(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_draw(rows, target):
    found = [(doc_id, *plain_features(text)) for doc_id, text in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for text in target for b in plain_features(text)[1])
    all_s, all_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    scored = []
    for doc_id, words, f in found:
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        scored.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    some = sorted((x for x in scored if x[5] >= 20), key=lambda x: (-x[3], x[0] is not None, x[0] or 0))
    for k, x in enumerate(some[: 5 * len(some) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in scored), key=str)


def drawn(docs, target):
    got = importance.resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted(map(tuple, got.collect()), key=str)


def test_documents_as_the_plain_draw(spark, tiny):
    target = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = drawn(tiny, target)
    assert got == plain_draw([(r.doc_id, r.text) for r in tiny.collect()], [r.text for r in target.collect()])
    assert len([r for r in got if r[4]]) > 5


def test_awkward_and_empty(spark, awkward, nothing):
    docs = awkward.withColumn("rank", F.lit(1))
    target = spark.createDataFrame([(None,), ("the cat sat",)], "text string")
    assert drawn(docs, target) == plain_draw([(r.doc_id, r.text) for r in docs.collect()], [None, "the cat sat"])
    assert drawn(nothing, target) == [] and len(drawn(docs, nothing)) == docs.count()


def test_equal_scores_take_different_ranks(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k l m n o p q r s t")] * 400, "doc_id long, text string")
    got = importance.resample(docs, docs.limit(0)).collect()
    assert sorted(r.rank for r in got if r.rank) == list(range(1, 21)) and len(got) == 400


WORDS = ["a", "Ab", "zeta9", "naïve", "日本語のテキスト", "x" * 50, "y" * 300, "🙂", "0"]


@pytest.mark.parametrize("most", [1, 7, 64, 1 << 20])
def test_features_of_slices_of_any_size(most):
    pick = np.random.default_rng(most)
    texts = ["", "  ", "!?"] + ["".join(str(pick.choice(WORDS)) + str(pick.choice([" ", "\n", "--", "_", "\x7f"])) for _ in range(int(pick.integers(0, 30)))) for _ in range(40)] + ["z" * 500]
    found, words = [Counter() for _ in texts], Counter()
    for of_words, of, buckets in importance.features(pa.array(texts), most):
        words.update(of_words.tolist())
        for k, b in zip(of.tolist(), buckets.tolist(), strict=True):
            found[k][b] += 1
    for k, text in enumerate(texts):
        w, f = plain_features(text)
        assert found[k] == Counter(f) and words[k] == len(w)


def test_slices_bound_what_is_held():
    text = "some words of a long text " * 20_000
    sizes = [len(data) for data, _, _ in importance.slices(pa.array([text, "x", text]), 1000)]
    assert max(sizes) <= 1000 and sum(sizes) == 2 * len(text) + 1


def test_crc_of_joined_texts():
    pick = np.random.default_rng(5)
    a = [pick.bytes(int(n)) for n in pick.integers(0, 40, 200)]
    b = [pick.bytes(int(n)) for n in pick.integers(0, 400, 200)]
    crc = lambda xs: np.array([zlib.crc32(x) for x in xs], np.uint32)
    got = importance.appended(crc(a), crc(b), np.array([len(x) for x in b]))
    assert got.tolist() == crc([x + y for x, y in zip(a, b, strict=True)]).tolist()
