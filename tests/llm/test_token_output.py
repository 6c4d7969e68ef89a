import functools
import random
import zlib
from array import array

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tagloom.llm import packing, token_output, tokens
from tagloom.llm.common import fresh_path

WORD, BYTE = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")


loaded = functools.cache(tokens.load)


def ids_of(path, text, end):
    return [*loaded(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(array("I", ids).tobytes())


def order(x):
    return (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or "")


@pytest.mark.parametrize("table", ["awkward", "tiny"])
def test_written_and_read_back(spark, request, table):
    docs = request.getfixturevalue(table)
    want, start = [], 0
    for doc_id, text in sorted((tuple(r) for r in docs.select("doc_id", "text").collect()), key=order):
        ids = ids_of(WORD, text, 1)
        want.append((doc_id, start, len(ids), crc(ids)))
        start += len(ids)
    to = fresh_path(spark, "tokens")
    token_output.write_tokens(docs, to, WORD)
    got = [tuple(r) for r in token_output.documents_of(spark, to).collect()]
    assert sorted(got, key=lambda r: r[1]) == want


def test_file_format(spark, tiny, tmp_path):
    to = str(tmp_path / "d")
    token_output.write_tokens(tiny, to, WORD, partitions=2)
    files = [f for f in (tmp_path / "d/tokens").glob("*.parquet") if pq.ParquetFile(f).metadata.num_rows]
    for f in files:
        group = pq.ParquetFile(f).metadata.row_group(0)
        columns = {group.column(k).path_in_schema: group.column(k) for k in range(group.num_columns)}
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        assert "RLE_DICTIONARY" in columns["tokens.list.element"].encodings
        assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings
    index = token_output.read_index(spark, to).orderBy("shard").collect()
    assert [r.ids_before for r in index] == [sum(x.n_tokens for x in index[:k]) for k in range(len(index))]


def scanned(df):
    """Rows that a query's scan gave on, once the page indexes had their say."""
    return df._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()


def test_range_reads_few_files_and_pages(spark, tmp_path):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    to = str(tmp_path / "d")
    token_output.write_tokens(docs, to, WORD, partitions=2)
    some = token_output.read_range(spark, to, 7000, 7009)
    library = tokens.load(WORD)
    rows = some.collect()
    assert sorted((r.doc_id, list(r.tokens)) for r in rows) == [(k, [*library.encode(f"text {k}", add_special_tokens=False).ids, 1]) for k in range(7000, 7010)]
    assert len(some.inputFiles()) == 1 and scanned(some) <= 2000
    everything = token_output.read_tokens(spark, to)
    everything.collect()
    assert scanned(everything) == 20_000
    light = token_output.read_range(spark, to, 0, 10**6, ("doc_id", "n_tokens"))
    assert light.count() == 20_000 and "tokens:" not in light._jdf.queryExecution().executedPlan().toString().replace("n_tokens:", "")
    assert token_output.read_range(spark, to, 30_000, 40_000).count() == 0


def test_hot_ids_are_dealt(spark, tmp_path):
    """An id and null with a third of the rows each: several shards, one order, all rows."""
    rows = [(None if k % 3 == 0 else 7 if k % 3 == 1 else k, f"t{k}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    to = str(tmp_path / "d")
    token_output.write_tokens(docs, to, WORD, partitions=9)
    sizes = [(r.first_doc, r.last_doc, r.n_docs) for r in token_output.read_index(spark, to).orderBy("shard").collect()]
    assert max(n for _, _, n in sizes) < 1000 and sum(n for *_, n in sizes) == 3000
    found = token_output.documents_of(spark, to).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and len(found) == 3000
    assert [r.start for r in found] == [sum(r.n_tokens for r in found[:k]) for k in range(3000)]
    assert sorted(r.ids_crc32 for r in found) == sorted(crc(ids_of(WORD, t, 1)) for _, t in rows)


def test_empty(spark, nothing):
    to = fresh_path(spark, "tokens")
    token_output.write_tokens(nothing, to, WORD)
    assert token_output.documents_of(spark, to).count() == 0
    assert packing.pack(nothing, BYTE).count() == 0


@pytest.mark.parametrize("table,pool", [("awkward", 3000), ("tiny", packing.POOL_TOKENS)])
def test_packing_holds_each_id_once(spark, request, table, pool):
    docs = request.getfixturevalue(table)
    pieces = packing.pack(docs, BYTE, pool_tokens=pool).collect()
    by_sequence, by_doc = {}, {}
    for p in pieces:
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
        by_doc.setdefault((p.doc_id, p.doc_tokens), []).append(p)
    for spans in by_sequence.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at and length > 0
            at += length
        assert at <= 1024 and at & (at - 1) == 0  # no padding
    texts = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert sum(p.length for p in pieces) == sum(len(ids_of(BYTE, t, 0)) for _, t in texts)
    for doc_id, text in texts:
        ids = ids_of(BYTE, text, 0)
        own = by_doc[doc_id, len(ids)]
        assert sorted({p.start for p in own})[0] == 0
        assert all(p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in own)
        copies = sum((d, t) == (doc_id, text) for d, t in texts)
        assert sum(p.length for p in own) == copies * len(ids)


def plain_balance(lengths, capacity):
    """The least-cost rule by looking at every sequence for each document."""
    room = packing.capacities(sum(lengths), capacity)
    size, cost, pieces = list(room), [0.0] * len(room), []
    queue = [(n, d, 0) for d, n in enumerate(lengths) if n]
    while queue:
        n, d, start = queue.pop(min(range(len(queue)), key=lambda k: (-queue[k][0], queue[k][1], queue[k][2])))
        fit = [s for s in range(len(room)) if room[s] >= n]
        s = min(fit, key=lambda s: (cost[s], s)) if fit else min((s for s in range(len(room)) if room[s]), key=lambda s: (-room[s], cost[s], s))
        take = min(n, room[s])
        pieces.append((d, start, take, s, size[s] - room[s]))
        room[s] -= take
        cost[s] += packing.LINEAR * take + packing.QUADRATIC * take * take
        if take < n:
            queue.append((n - take, d, start + take))
    return pieces


@pytest.mark.parametrize("seed", range(6))
def test_balance_equals_the_plain_rule(seed):
    pick = random.Random(seed)
    lengths = [pick.choice((0, 1, pick.randrange(20), pick.randrange(200), pick.randrange(900))) for _ in range(120)]
    assert sorted(packing.balanced(lengths, 128)) == sorted(plain_balance(lengths, 128))


def test_balanced_costs():
    pieces = packing.balanced([900, 700, 500, 300, 124, 100, 24, 24] * 16)
    cost = {}
    for _, _, n, s, _ in pieces:
        cost[s] = cost.get(s, 0) + packing.LINEAR * n + packing.QUADRATIC * n * n
    full = [c for c in cost.values() if c > 1000]
    assert max(full) / min(full) < 1.5
    assert packing.capacities(2 * 1024 + 700, 1024) == [1024, 1024, 512, 128, 32, 16, 8, 4]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_memo_equals_the_library(path):
    encode, library, pick = tokens.Encoder(path), tokens.load(path), random.Random(5)
    encode.memo.most = 50
    odd = ["", "a  b", "It's don't  x\n\ny <|endoftext|> z", "\tfoo\r\nbar", "İ ΣΑΣ ΟΔΟΣ x", "é x́.", "foo... bar!? 'tis", "a\xa0b c　d", "a\n", "\na b", " ", "w\x1cx", "a ́b", "ß, ẞ. DŽ dž"]
    odd += ["".join(pick.choice(" \n.,!'sS aébß1²́<|_") for _ in range(50)) for _ in range(1500)]
    for text in odd:
        assert encode(text) == array("I", library.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)
