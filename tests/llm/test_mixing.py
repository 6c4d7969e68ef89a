import hashlib
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from tagloom.llm import mixing
from tagloom.llm.common import split_words, stored

SCHEMA = "doc_id long, source string, text string"


def plain_targets(size, weights=(5, 2, 1), epochs=3):
    """Exact targets by the rule: share what is left by weight, stop those above their cap, again."""
    names = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, capped = sum(size.values()), {}
    while True:
        open_ = [s for s in names if s not in capped]
        share = {s: Fraction(w[s] * left, sum(w[t] for t in open_)) for s in open_}
        over = [s for s in open_ if share[s] > epochs * size[s]]
        if not over:
            return share | capped
        for s in over:
            capped[s] = Fraction(epochs * size[s])
            left -= epochs * size[s]


def plain_mix(rows):
    size, docs = Counter(), []
    for doc_id, source, text in rows:
        n = len(split_words(text))
        size[source] += n
        docs.append((source, hashlib.md5(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest(), doc_id is not None, doc_id or 0, n))
    targets, out, used = plain_targets(size), [], Counter()
    for source, _, known, doc_id, n in sorted(docs, key=lambda d: (d[1:], str(d[0]))):
        words = int(targets[source])
        whole, rest = divmod(words, size[source]) if size[source] else (0, 0)
        part = max(0, min(n, rest - used[source]))
        used[source] += n
        out.append((doc_id if known else None, n, size[source], round(float(targets[source]), 6), n * whole + part))
    return sorted(out, key=str)


def mixed(docs):
    got = mixing.taken(stored(mixing.sizes(docs), "mix-test"))
    return sorted(((r.doc_id, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got.collect()), key=str)


def test_documents_as_the_plain_mix(spark, tiny):
    got = mixed(tiny)
    assert got == plain_mix([(r.doc_id, r.source, r.text) for r in tiny.collect()]) == mixed(tiny.repartition(7))


def test_each_source_takes_its_target(spark, tiny):
    got = mixing.taken(stored(mixing.sizes(tiny), "mix-test"))
    sums = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"), F.first("source_size").alias("source_size"))
    assert sums.where("abs(taken - target) >= 1 or size <> source_size or target > 3 * source_size").isEmpty()
    assert got.where("taken > 3 * size or taken < 0").isEmpty() and not got.where("taken > size").isEmpty()


def test_several_rounds_of_clamping(spark):
    sizes = {f"s{i:02d}": 3**i for i in range(9)} | {None: 7, "zz": 0}
    rows = [(i, s, " ".join(["w"] * (n - n // 2)) if half else " ".join(["w"] * (n // 2))) for i, (s, n) in enumerate(sizes.items()) for half in (0, 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert mixed(docs) == plain_mix(rows)
    table = spark.createDataFrame([(s, n, 5) for s, n in sizes.items()], "source string, size long, w long")
    got = {r.source: r.target for r in mixing.filled(table).collect()}
    want = plain_targets(sizes, (5,))
    assert got == pytest.approx({s: float(x) for s, x in want.items()}) and sum(got.values()) == pytest.approx(sum(sizes.values()))
    assert len([s for s in sizes if want[s] == 3 * sizes[s]]) > 4
    with pytest.raises(ValueError):
        mixing.filled(table, 0)


def test_weights_go_round_by_code_point(spark):
    sources = spark.createDataFrame([(s, 1) for s in ["b", "a", "é", None, "Z", "", "🙂"]], "source string, size long")
    assert {r.source: r.w for r in mixing.weighed(sources).collect()} == {"": 5, "Z": 2, "a": 1, "b": 5, "é": 2, "🙂": 1, None: 5}


def test_hot_source_repeated_rows_and_one_slot(spark):
    rows = [(1, "a", "x y z")] * 40 + [(i, "b", "w " * i) for i in range(60)] + [(None, None, "q")] * 3
    docs = spark.createDataFrame(rows, SCHEMA)
    assert mixed(docs) == plain_mix(rows)


def test_awkward_and_empty(spark, awkward, nothing):
    assert mixed(awkward) == plain_mix([(r.doc_id, r.source, r.text) for r in awkward.collect()])
    assert mixed(nothing) == []
    blank = spark.createDataFrame([(1, "a", None), (2, "b", " ")], SCHEMA)
    assert mixed(blank) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_texts_of_the_mix(spark, tiny):
    docs = tiny.withColumn("copy", F.lit("x"))
    out = mixing.mix(docs)
    assert out.columns == [*docs.columns, "_copy"]
    words = {(r.doc_id, r._copy): len(split_words(r.text)) for r in out.collect()}
    want = {r.doc_id: r.taken for r in mixing.taken(stored(mixing.sizes(tiny), "mix-test")).collect() if r.taken}
    sums = Counter()
    for (doc_id, _), n in words.items():
        sums[doc_id] += n
    assert dict(sums) == want
    whole = {r.doc_id: r.text for r in tiny.collect()}
    part = [r for r in out.collect() if r.text != whole[r.doc_id]]
    assert part and all(split_words(whole[r.doc_id])[: len(split_words(r.text))] == split_words(r.text) for r in part)
