import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tagloom.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    values = {**row, "text": text}
    return sha(*("-" if values[c] is None else f"{len(str(values[c]).encode())}:{values[c]}" for c in FIELDS))


def plain_tree(nodes):
    """Root, and the (left, right) siblings of each leaf, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k, i in enumerate(at):
            run = nodes[i // 8 * 8 : i // 8 * 8 + 8]
            paths[k].append((run[: i % 8], run[i % 8 + 1 :]))
        nodes, at = [sha(*nodes[i : i + 8]) for i in range(0, len(nodes), 8)], [i // 8 for i in at]
    return nodes[0], paths


def plain_manifest(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for r in rows:
        leaf, start = plain_leaf(r, r["text"]), plain_leaf(r, r["text"])
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
            start = plain_leaf(r, r["text"].translate(lower))
        groups.setdefault(r["lang"], []).append((r["doc_id"], leaf, start))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = []
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees.append(plain_tree([x[1] for x in groups[g]]))
    root, upper = plain_tree([t[0] for t in trees])
    out = []
    for g, (subroot, paths), above in zip(names, trees, upper, strict=True):
        for (doc_id, leaf, start), path in zip(groups[g], paths, strict=True):
            now, proof = start, ""
            for left, right in path + above:
                now, proof = sha(*left, now, *right), proof + "".join(left + right)
            out.append((doc_id, leaf, subroot, root, sha(proof), now, now == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("per_task", [200_000, 40, 7])
def test_documents_as_the_plain_tree(spark, tiny, per_task):
    got = rows_of(merkle.manifest(tiny, leaves_per_task=per_task))
    assert got == plain_manifest([r.asDict() for r in tiny.collect()])
    assert not all(r[-1] for r in got) and any(r[-1] for r in got)


@pytest.mark.parametrize("n", [1, 8, 9, 64, 65, 513])
def test_sizes_around_full_runs(spark, n):
    docs = spark.createDataFrame([(i, "s", "en", i, f"Text {i}") for i in range(n)], SCHEMA).repartition(3)
    assert rows_of(merkle.manifest(docs, leaves_per_task=11)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_many_small_groups_beside_a_large_one(spark):
    rows = [(i, None, f"g{i}" if i % 3 else "large", None, None if i % 5 else "Some") for i in range(400)] + [(None, "s", None, 4, "x"), (7, "s", None, 4, "É")]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert rows_of(merkle.manifest(docs, leaves_per_task=13)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_repeated_rows_are_dealt_out(spark):
    docs = spark.createDataFrame([(5, "s", "en", 3, "Abc")] * 300 + [(None, None, None, None, None)] * 3, SCHEMA)
    assert rows_of(merkle.manifest(docs, leaves_per_task=20)) == plain_manifest([r.asDict() for r in docs.collect()])


def test_awkward_and_empty(spark, awkward, nothing):
    docs = awkward.withColumn("n_chars", F.length("text")).withColumns({"grp": F.lit(1), "leaf": F.lit("x")})
    got = merkle.manifest(docs)
    assert rows_of(got) == plain_manifest([r.asDict() for r in docs.collect()])
    assert merkle.manifest(nothing.withColumn("n_chars", F.lit(1))).collect() == [] and got.columns[0] == "doc_id"


def test_any_change_breaks_the_proof(spark, tiny):
    got = merkle.manifest(tiny.where("text is not null"), tampered=lambda key: F.lit(True)).join(tiny.select("doc_id", "text"), "doc_id")
    assert got.where(F.col("verified") != (F.col("text").rlike("[A-Z]") == F.lit(False))).isEmpty()
    assert merkle.manifest(tiny, tampered=lambda key: F.lit(False)).where("not verified").isEmpty()


def test_a_partition_is_sent_few_nodes(spark):
    """Loose nodes are at either end of a partition, at most seven a level, not its leaves."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.lit("en").alias("lang"), F.lit(1).alias("n_chars"), F.lit("x").alias("text"))
    leaves = [f"{k:064d}" for k in range(5_003)]
    s = merkle.grown(0, 20_000, 9_999, leaves)
    row = type("Row", (), {})
    rows = []
    for x in leaves:
        r = row()
        r.grp, r.leaf = "en", x
        rows.append(r)
    found = list(merkle.loose(0, iter(rows), merkle.Place(0, 9_999, 20_000, 20_000)))
    assert len(found) <= 14 * len(s.levels) and len(s.levels) >= 4
    assert merkle.manifest(docs, leaves_per_task=3_000).where("not verified").isEmpty()
