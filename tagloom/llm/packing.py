"""Cost-balanced packing of token sequences.

The cost of a sequence is estimated as linear plus quadratic attention cost of its pieces (attention doesn't cross from one
document to another): sum of a*n + b*n*n. Documents, longest first, go to the sequence of least cost that has room for
them; a document for which none has room fills the one with most room, and its rest queues again. The sequences' capacities
add up to exactly the tokens at hand: full ones, and powers of two for the remainder, so none is padded.

Each task packs its documents in pools of POOL_TOKENS tokens, so nothing is shuffled, memory is bounded by a pool, and a
retried task gives the same sequences (their ids hold the partition's number).

Defined cases: null and empty texts are one piece, the end id; a document longer than a pool is a pool with what came
before it; repeated rows are packed each; ties go to the earlier document and the lower sequence.
"""

from __future__ import annotations

import heapq
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tagloom.llm.common import releasing
from tagloom.llm.tokens import encoder, sliced, tokenizer_path

CAPACITY = 1024
END_ID = 0
POOL_TOKENS = 4_000_000
#: Cost of n tokens of one document: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def capacities(tokens: int, capacity: int) -> list[int]:
    """Full sequences, then powers of two for what is left."""
    full, rest = divmod(tokens, capacity)
    return [capacity] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def balanced(lengths, capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill all sequences."""
    free = capacities(int(sum(lengths)), capacity)
    size = free.copy()
    queue = [(-int(n), d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(queue)
    open_ = [(0.0, s) for s in range(len(free))]  # sequences with room for the next document, by cost
    parked: list[tuple[int, float, int]] = []  # the others, by room
    pieces = []
    while queue:
        n, d, start = heapq.heappop(queue)
        n = -n
        while parked and -parked[0][0] >= n:
            _, cost, s = heapq.heappop(parked)
            heapq.heappush(open_, (cost, s))
        while open_ and free[open_[0][1]] < n:
            cost, s = heapq.heappop(open_)
            heapq.heappush(parked, (-free[s], cost, s))
        if open_:
            cost, s = heapq.heappop(open_)
            take = n
        else:
            _, cost, s = heapq.heappop(parked)
            take = free[s]
            heapq.heappush(queue, (take - n, d, start + take))
        pieces.append((d, start, take, s, size[s] - free[s]))
        free[s] -= take
        if free[s]:
            heapq.heappush(open_, (cost + linear * take + quadratic * take * take, s))
    return pieces


def pack_rows(path: str, end_id: int, capacity: int, pool_tokens: int):
    """A function for mapInArrow: (doc_id, text) -> rows of SCHEMA."""
    end = array("I", [end_id]).tobytes()

    def packed(docs, ids, first):
        pieces = balanced([len(x) // 4 for x in ids], capacity)
        d, start, length, s, offset = (np.array(x, np.int64) for x in zip(*pieces, strict=True))
        crc = [zlib.crc32(ids[i][4 * a : 4 * (a + n)]) for i, a, n, _, _ in pieces]
        columns = [pa.array(docs, pa.int64()).take(pa.array(d)), start, length, crc, np.array([len(x) // 4 for x in ids], np.int64)[d], s + first, offset]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=SCHEMA.replace(" long", "").split(", ")), first + int(s.max()) + 1

    def run(batches):
        encode, first = encoder(path), TaskContext.get().partitionId() << 32
        docs, ids, held = [], [], 0
        for batch in batches:
            for lo, texts in sliced(batch.column(1)):
                for doc_id, x in zip(batch.column(0).slice(lo, len(texts)).to_pylist(), encode.many(texts), strict=True):
                    docs.append(doc_id)
                    ids.append(x + end)
                    held += len(ids[-1]) // 4
                    if held >= pool_tokens:
                        out, first = packed(docs, ids, first)
                        yield out
                        docs, ids, held = [], [], 0
        if docs:
            yield packed(docs, ids, first)[0]

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, capacity: int = CAPACITY, pool_tokens: int = POOL_TOKENS) -> DataFrame:
    """Pieces of all docs(doc_id, text), as SCHEMA has them."""
    return docs.select("doc_id", "text").mapInArrow(releasing(pack_rows(tokenizer, end_id, capacity, pool_tokens)), SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
