"""Target-distribution importance resampling: documents drawn by how much their hashed n-grams look like a target's.

Features are the runs of one to three words, hashed to BUCKETS buckets; a bucket's gain is the logarithm of its smoothed share in the
target over that in the documents. A document's weight is the sum of its features' gains, and noise from a seeded hash makes the
highest scores a draw without replacement.

1. First pass over Arrow batches: np.bincount of the features' buckets gives one vector a partition; treeReduce adds them up.
2. The gains (80 kB) are broadcast; the second pass gathers them by bucket and sums documents by bincount weights.
3. The eligible (doc_id, score) are range-sorted; a rank is the place in a partition after the counts of the partitions before.
   So no task ranks them all, and documents of one score are dealt out as well.

Features are hashed without a loop over words: words are found on the bytes of a slice of texts, their crc32 grows byte by byte for all words at once, and a
run's crc32 comes from those of its words, since appending k bytes is a linear map of the 32 bits (four tables of 256 for each k). Slices hold SLICE_BYTES
of text; a longer text goes on in the next slice with its last two words carried over, so memory doesn't grow with a text.

Defined cases: null, empty and blank texts have no features, weight 0 and are not eligible; a null doc_id is drawn by the hash of "42:";
repeated rows count and are drawn each for itself, in any order among equal (score, doc_id); without eligible documents no row has a rank.
"""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.functions.ranks import placed
from tagloom.llm.common import documents, releasing, stored
from tagloom.llm.merkle import CRC_SQL, crc_sql

BUCKETS, LONGEST_RUN, SEED = 10_000, 3, 42
#: Percent of the eligible documents that are drawn, and the words that make a document eligible.
DRAWN, LEAST_WORDS = 5, 20
#: Bytes of text whose words are held at once.
SLICE_BYTES = 2 << 20
#: Words up to so many bytes are hashed together, longer ones one by one; table of appended bytes.
SHORT, APPENDED = 48, 64
#: Fixed value: the polynomial of crc32, reversed.
POLYNOMIAL = 0xEDB88320
COUNTS = "total long, counts binary"
WEIGHED = "doc_id long, n_words long, n_features long, weight long, score long"


@functools.cache
def crc_table() -> np.ndarray:
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(POLYNOMIAL), c >> 1).astype(np.uint32)
    return c


@functools.cache
def append_tables() -> np.ndarray:
    """[k, byte of the crc, its value]: what k appended zero bytes make of it."""
    out = np.empty((APPENDED + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(APPENDED):
        out[k + 1] = (out[k] >> 8) ^ crc_table()[out[k] & 255]
    return out


def appended(crc: np.ndarray, other: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of texts of crc, each with a text of crc `other` and so many bytes after it."""
    tables, crc, left = append_tables(), crc.copy(), size.astype(np.int64)

    def zeros(c: np.ndarray, k: np.ndarray) -> np.ndarray:
        return tables[k, 0, c & 255] ^ tables[k, 1, (c >> 8) & 255] ^ tables[k, 2, (c >> 16) & 255] ^ tables[k, 3, c >> 24]

    while len(far := np.flatnonzero(left > APPENDED)):
        crc[far] = zeros(crc[far], np.full(len(far), APPENDED))
        left[far] -= APPENDED
    return zeros(crc, left) ^ other


def word_crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """crc32 of the words of data at start with size bytes."""
    table, out = crc_table(), np.full(len(start), 0xFFFFFFFF, np.uint32)
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")  # so that those still growing come first
    at, n = start[order], size[order]
    some = int(np.searchsorted(-n, -SHORT))  # those before are longer than SHORT
    c = out[some:]
    at, n = at[some:], n[some:]
    for k in range(int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -k))  # words of more than k bytes
        c[:m] = (c[:m] >> 8) ^ table[(c[:m] ^ data[at[:m] + k]) & 255]
    out ^= np.uint32(0xFFFFFFFF)
    for k in range(some):
        lo = int(start[order[k]])
        out[k] = zlib.crc32(data[lo : lo + int(size[order[k]])])
    back = np.empty_like(out)
    back[order] = out
    return back


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """data with A-Z lower-cased, and which bytes belong to words: digits, letters and all of other characters."""
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return low, ((low >= 48) & (low <= 57)) | ((low >= 97) & (low <= 122)) | (low >= 128)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, numbers of the texts in them, where each begins) of consecutive slices; a long text is cut after a byte that is in no word, where it has one."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    lo, end = int(offsets[0]), int(offsets[-1])
    while lo < end:
        hi = min(end, lo + most)
        if hi < end:
            k = int(np.searchsorted(offsets, hi, "right")) - 1  # the text that holds byte hi
            if offsets[k] > lo:
                hi = int(offsets[k])
            else:  # within one text: back to a border, else on to one
                free = np.flatnonzero(~word_bytes(data[lo:hi])[1])
                if len(free):
                    hi = lo + int(free[-1]) + 1
                else:
                    stop = int(offsets[k + 1])
                    while hi < stop and word_bytes(data[hi : hi + 1])[1][0]:
                        hi += 1
        first, last = int(np.searchsorted(offsets, lo, "right")) - 1, int(np.searchsorted(offsets, hi, "left"))
        texts_here = np.arange(first, last)
        yield data[lo:hi], texts_here, np.maximum(offsets[first:last] - lo, 0)
        lo = hi


def features(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of texts (no nulls): the texts of their words, and text and bucket of each feature that ends in them."""
    blank = np.uint32(zlib.crc32(b" "))
    kept_of, kept_crc, kept_size = np.empty(0, np.int64), np.empty(0, np.uint32), np.empty(0, np.int64)
    for data, numbers, begins in slices(texts, most):
        low, inside = word_bytes(data)
        edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
        cut = np.zeros(len(data) + 1, bool)
        cut[begins] = True  # one text's last word isn't the next one's first
        met = np.flatnonzero(cut[:-1] & inside & np.concatenate(([False], inside[:-1])))
        start = np.sort(np.concatenate((np.flatnonzero(edge == 1), met)))
        stop = np.sort(np.concatenate((np.flatnonzero(edge == -1), met)))
        of = numbers[np.searchsorted(begins, start, "right") - 1]
        new = len(of)
        held = len(kept_of)
        of = np.concatenate((kept_of, of))
        crc = np.concatenate((kept_crc, word_crcs(low, start, stop - start)))
        size = np.concatenate((kept_size, stop - start))
        after = appended(np.full(len(crc), blank), crc, size)  # of a blank and the word
        found_of, found = [of[held:]], [crc[held:]]
        run = crc
        for n in range(1, LONGEST_RUN):
            run = appended(run[:-1], after[n:], size[n:] + 1)
            ends = np.arange(n, len(of))
            mine = (of[n:] == of[:-n]) & (ends >= held)
            found_of.append(of[n:][mine])
            found.append(run[mine])
        yield of[held:] if new else of[:0], np.concatenate(found_of), (np.concatenate(found) % BUCKETS).astype(np.int64)
        keep = LONGEST_RUN - 1
        kept_of, kept_crc, kept_size = of[-keep:], crc[-keep:], size[-keep:]


def counted(batches):
    """For mapInArrow: texts -> one row, the number of features and the counts of the buckets."""
    counts = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for _, _, buckets in features(batch.column(0).fill_null("")):
            counts += np.bincount(buckets, minlength=BUCKETS)
    yield pa.RecordBatch.from_arrays([pa.array([int(counts.sum())], pa.int64()), pa.array([counts.tobytes()], pa.binary())], names=["total", "counts"])


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """Features of all texts (one column) in each bucket."""
    vectors = texts.mapInArrow(releasing(counted), COUNTS).select("counts").rdd.map(lambda r: np.frombuffer(r.counts, np.int64))
    return vectors.treeReduce(np.add) if vectors.getNumPartitions() else np.zeros(BUCKETS, np.int64)


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    all_s, all_t = int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (all_s + BUCKETS) / ((s + 1) * (all_t + BUCKETS)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], float)


def noise(doc_id: int | None, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigher(gain, seed: int):
    """For mapInArrow: (doc_id, text) -> WEIGHED."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, some, weight = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
            for of_words, of, buckets in features(batch.column(1).fill_null("")):
                words += np.bincount(of_words, minlength=n)
                some += np.bincount(of, minlength=n)
                weight += np.bincount(of, gain.value[buckets], n)  # whole numbers, exact in doubles
            score = weight.astype(np.int64) + np.array([noise(k, seed) for k in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, some, weight.astype(np.int64), score))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def resample(docs: DataFrame, target: DataFrame, drawn: int = DRAWN, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (null if not drawn) of each row of docs, drawn towards target(text)."""
    spark = docs.sparkSession
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs.select("text")), bucket_counts(target.select("text"))))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(releasing(weigher(gain, seed)), WEIGHED), "importance")
    eligible = F.col("n_words") >= least_words
    some = rows.where(eligible)
    most = drawn * some.count() // 100
    ranked = placed(some, [F.desc("score"), F.col("doc_id").asc_nulls_first()], "rank")
    rank = F.when(F.col("rank") <= most, F.col("rank"))
    return ranked.withColumn("rank", rank).unionByName(rows.where(~eligible).withColumn("rank", F.lit(None).cast("long")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def _sql_features(table: str) -> str:
    """Rows (r, f) of the features of a table's texts."""
    words = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    runs = ", ".join(f"list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' '))" for n in range(1, LONGEST_RUN + 1))
    return f"SELECT r, len(w) AS n, unnest(flatten([{runs}])) AS f FROM (SELECT row_number() OVER () AS r, {words} AS w FROM {table}) z"


ORACLE = f"""WITH {CRC_SQL},
p AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
d AS MATERIALIZED (SELECT r, n, f FROM ({_sql_features("p").replace("row_number() OVER () AS r", "r")}) z),
b AS MATERIALIZED (SELECT f FROM ({_sql_features("benchmark")}) z),
k AS MATERIALIZED (SELECT f, {crc_sql("f")} % {BUCKETS} AS k FROM (SELECT DISTINCT f FROM (SELECT f FROM d UNION ALL SELECT f FROM b) z) y, crc),
s AS (SELECT k, count(*) AS s FROM d JOIN k USING (f) GROUP BY 1),
t AS (SELECT k, count(*) AS t FROM b JOIN k USING (f) GROUP BY 1),
g AS MATERIALIZED (SELECT x.k, CAST(floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM d) + {BUCKETS}) / ((coalesce(s, 0) + 1) * ((SELECT count(*) FROM b) + {BUCKETS})))) AS BIGINT) AS gain FROM (SELECT DISTINCT k FROM k) x LEFT JOIN s ON s.k = x.k LEFT JOIN t ON t.k = x.k),
o AS (SELECT r, count(*) AS n_features, sum(gain) AS weight, max(n) AS n FROM d JOIN k USING (f) JOIN g ON g.k = k.k GROUP BY r),
x AS (SELECT p.r, doc_id, coalesce(n, 0) AS n, CAST(coalesce(n_features, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
 CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM p LEFT JOIN o ON o.r = p.r),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS rank FROM y WHERE n >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {DRAWN} * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z USING (r)"""
