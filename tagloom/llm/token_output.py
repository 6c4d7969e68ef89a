"""Token ids as Parquet that can be read in part.

Layout of a dataset at a path: `tokens/` holds one row per document in ascending doc_id order over the files, with columns
shard, pos, doc_id, n_tokens (delta-encoded) and tokens (a list column, dictionary-encoded while the dictionary fits a
page); `index/` holds one row per shard: its file, its doc_id range, number of documents and tokens, and the number of ids
before it. Row groups and pages are small and carry column and page indexes: `read_range` opens the files that the index has for a
range of doc_ids and reads their pages of that range, and of the columns asked for only. Documents are range-partitioned
and sorted before they are encoded, so no id is ever shuffled. There is a shard for each SHARD_BYTES of the input's files, or as
many as the session has shuffle partitions; a doc_id (or null) with more than a shard's rows is dealt over several.

Defined cases: null and empty texts hold the end id only; null doc_ids come first; rows with equal doc_id are repeated and
keep one order in the files; an empty table gives an empty dataset. Further columns of the input are ignored. A text of any
length is encoded by itself, with its ids in one list of one row.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.llm.common import fresh_path, is_scan, releasing
from tagloom.llm.tokens import encoder, tokenizer_path

ROW_GROUP_BYTES = 16 << 20
PAGE_BYTES = 128 << 10
END_ID = 1
#: Bytes of the input's files for each shard.
SHARD_BYTES = 128 << 20
#: Borders between partitions that an expression may hold; with more, whole rows are sampled.
MOST_BORDERS = 2000
SCHEMA = "shard int, pos long, doc_id long, n_tokens long, tokens array<int>"
FORMAT = {
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "false",
    "parquet.enable.dictionary#tokens.list.element": "true",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.block.size": str(ROW_GROUP_BYTES),
    "parquet.page.size": str(PAGE_BYTES),
    "parquet.page.row.count.limit": "1000",
    "compression": "zstd",
    "parquet.compression.codec.zstd.level": "1",
}


def encode_rows(path: str, end_id: int):
    """A function for mapInArrow: (doc_id, text) in order -> rows of SCHEMA."""
    end = array("I", [end_id]).tobytes()

    def run(batches):
        encode, shard, pos = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                ids = [x + end for x in encode.many(part.column(1))]
                n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.int32)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, np.int32)), pa.array(np.arange(pos, pos + len(n))), part.column(0), pa.array(n), tokens],
                    names=["shard", "pos", "doc_id", "n_tokens", "tokens"],
                )
                pos += len(n)

    return run


def by_doc_id(docs: DataFrame, n: int) -> DataFrame:
    """docs in n partitions that follow each other by doc_id, nulls first. The borders come from doc_id alone; partitioning by
    range would read the texts once more to sample whole rows."""
    tie = F.xxhash64("text")
    if n > MOST_BORDERS:
        return docs.repartitionByRange(n, "doc_id", tie)
    total, some, borders = docs.select(F.count("*"), F.count("doc_id"), F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 10_000)).first()
    first = -(-n * (total - some) // max(1, total))  # partitions of the nulls
    borders = sorted((borders or [])[:: max(1, -(-(n - 1) // max(1, n - 1 - first)))]) if n - 1 > first else []
    place = F.when(F.col("doc_id").isNull(), F.pmod(tie, F.lit(max(1, first)))).otherwise(first + _place(F.col("doc_id"), tie, borders))
    return docs.repartitionById(first + len(borders) + 1, place.cast("int"))


def _place(x: Column, tie: Column, borders: list[int]) -> Column:
    """How many of the sorted borders lie at or below x, by halving. An x that is itself k borders is dealt over k partitions."""
    different = sorted({*borders})
    below = [sum(b < x for b in borders) for x in different] + [len(borders)]

    def of(lo: int, hi: int) -> Column:  # x is at or above different[lo - 1] and below different[hi]
        if lo == hi:
            times = below[lo] - below[lo - 1] if lo else 1
            last = F.lit(below[lo])
            return last if times == 1 else F.when(x == different[lo - 1], below[lo - 1] + 1 + F.pmod(tie, F.lit(times))).otherwise(last)
        mid = (lo + hi) // 2
        return F.when(x < different[mid], of(lo, mid)).otherwise(of(mid + 1, hi))

    return of(0, len(different))


def shards_of(docs: DataFrame) -> int:
    """Shards for the input's size, as its files tell it."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(n, docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() // SHARD_BYTES) if is_scan(docs) else n


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = END_ID, partitions: int | None = None) -> None:
    """Encode docs(doc_id, text) and write the dataset."""
    spark = docs.sparkSession
    ordered = by_doc_id(docs.select("doc_id", "text"), partitions or shards_of(docs)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(releasing(encode_rows(tokenizer, end_id)), SCHEMA).write.options(**FORMAT).parquet(f"{to}/tokens")
    written = spark.read.schema(SCHEMA).parquet(f"{to}/tokens")
    rows = written.select("shard", "doc_id", "n_tokens", written.metadataColumn("_metadata")["file_path"].alias("file"))
    shards = rows.groupBy("shard", "file").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    shards.withColumn("ids_before", F.coalesce(F.sum("n_tokens").over(before), F.lit(0).cast("long"))).write.parquet(f"{to}/index")


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{at}/tokens")


def read_index(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.schema("shard int, file string, first_doc long, last_doc long, n_docs long, n_tokens long, ids_before long").parquet(f"{at}/index")


def read_range(spark: SparkSession, at: str, first: int, last: int, columns: tuple[str, ...] = ("doc_id", "tokens")) -> DataFrame:
    """These columns of the documents with ids from first to last: from their shards' files, and of those the pages of that range."""
    files = [r.file for r in read_index(spark, at).where((F.col("first_doc") <= last) & (F.col("last_doc") >= first)).select("file").collect()]
    rows = spark.read.schema(SCHEMA).parquet(*files) if files else read_tokens(spark, at)
    return rows.where(F.col("doc_id").between(first, last)).select(*columns)


def with_crc(batches):
    for batch in batches:
        tokens = batch.column(4)
        ids, at = tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), tokens.offsets.to_numpy()
        crc = [zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), pa.array(crc, pa.int64())], names=["shard", "pos", "doc_id", "n_tokens", "ids_crc32"])


def documents_of(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document of a dataset, from its files."""
    rows = read_tokens(spark, at).mapInArrow(releasing(with_crc), "shard int, pos long, doc_id long, n_tokens long, ids_crc32 long")
    within = W.partitionBy("shard").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    joined = placed.join(read_index(spark, at).select("shard", "ids_before"), "shard")  # one row per file; broadcast if small
    return joined.select("doc_id", (F.col("ids_before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = fresh_path(spark, "token-output")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), to, tokenizer_path("word_bpe_49k.json"))
    return documents_of(spark, to)
