"""Exact de-duplication through a log-structured merge index of digests.

1. Log: every row gets its digest (SHA-256 of the text without blanks), its length and its number; the log is a table of
   about a hundred bytes a row, and the texts are not moved.
2. Memtables: each consecutive slice of the log goes to one task, which sorts it by digest, keeps the best row of each digest
   (most code points, then smallest doc_id) and the number of its rows, and flushes that as a sorted run.
3. Appends: the log is appended in APPENDS parts. The runs of a part are merged into one of the next level, with a filter of
   its digests. The new run's digests are looked up in all earlier runs, through their filters: what passes a filter is
   searched in that run, and what is found there, like a digest of several rows within the part, is a hit.
4. Compaction: the runs of the parts merge into one; per digest the best row and the number of rows stay.
5. Byte verification: a filter sized by the number of hits keeps all other rows out; the least and the greatest text of each
   hit digest must be the same bytes. Partial aggregation makes this one row per digest and task, however large a group
   is. Digests that fail (a collision) are split by text.

Defined cases: null text counts as empty; empty texts form one group; of rows with equal length and doc_id (repeated
rows) exactly one is kept, the first in the table's files; null doc_ids rank last. Columns besides doc_id and text are ignored
and may have any name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import discard, flagged, join_classes, key_filter, numbered, only_rows, parted, stored, without_blanks

#: Rows of one memtable, which one task holds: about 7 MB of log.
MEMTABLE_ROWS = 1 << 16
#: Parts in which a log is appended, each a few jobs; fewer if they wouldn't fill a memtable.
APPENDS = 4


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def normalised(text: Column) -> Column:
    return without_blanks(F.coalesce(text, F.lit("")))


@dataclass
class Run:
    """A sorted table (digest, best, n) of `rows` rows, and the filter of its digests."""

    table: DataFrame
    rows: int
    bitmaps: DataFrame


def _merged(entries: DataFrame, *keys: str) -> DataFrame:
    return entries.groupBy(*keys, "digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))


class DigestIndex:
    """Runs of one level, and the hits that were found when they were appended."""

    def __init__(self, memtable_rows: int = MEMTABLE_ROWS):
        self.memtable_rows = memtable_rows
        self.runs: list[Run] = []
        self.hits: list[DataFrame] = []

    def flush(self, log: DataFrame, first: int, end: int) -> DataFrame:
        """The runs of the log's rows from first to end: a memtable and task for each memtable_rows of them."""
        part = log.where((F.col("row") >= first) & (F.col("row") < end))
        memtable = F.floor((F.col("row") - first) / self.memtable_rows).cast("int")
        entries = part.select(memtable.alias("memtable"), "digest", "best", F.lit(1).cast("long").alias("n"))
        dealt = entries.repartition(-(-(end - first) // self.memtable_rows), "memtable")
        return stored(_merged(dealt, "memtable").sortWithinPartitions("memtable", "digest"), "digest-runs")

    def append(self, log: DataFrame, first: int, end: int) -> None:
        """Index the rows of log(row, digest, best) from first to end."""
        table = self.flush(log, first, end)
        if end - first > self.memtable_rows:
            runs, table = table, stored(_merged(table).sortWithinPartitions("digest"), "digest-run")
            discard(runs)
        rows = table.count()
        self.hits.append(table.where("n > 1").select("digest"))
        for run in self.runs:
            self.hits.append(self.lookup(table, run))
        self.runs.append(Run(table, rows, stored(key_filter(table, "digest", rows), "digest-filter")))

    @staticmethod
    def lookup(table: DataFrame, run: Run) -> DataFrame:
        """The digests of table that are in an earlier run. Only those that pass its filter are searched for."""
        maybe = flagged(table.select("digest"), "digest", run.bitmaps, run.rows, "passes").where("passes").select("digest")
        return stored(run.table.select("digest").join(maybe, "digest", "left_semi"), "digest-hits")

    def compact(self) -> DataFrame:
        """Merge all runs into one."""
        if len(self.runs) == 1:
            return self.runs[0].table
        entries = self.runs[0].table.select("digest", "best", "n")
        for run in self.runs[1:]:
            entries = entries.unionByName(run.table.select("digest", "best", "n"))
        merged = stored(_merged(entries).sortWithinPartitions("digest"), "digest-index")
        discard(*(x for run in self.runs for x in (run.table, run.bitmaps)))
        return merged

    def found(self) -> DataFrame:
        """All hits, each digest once; asked for before the runs are compacted."""
        hits = self.hits[0]
        for more in self.hits[1:]:
            hits = hits.unionByName(more)
        return stored(hits.distinct(), "digest-hits")


def indexed(log: DataFrame, rows: int, memtable_rows: int, appends: int) -> tuple[DataFrame, DataFrame]:
    """(the index of log(row, doc_id, n_chars, digest), its hits)."""
    best = F.struct((-F.col("n_chars")).alias("less"), F.col("doc_id").isNull().alias("void"), "doc_id", "row")
    entries = log.select("row", "digest", best.alias("best"))
    index = DigestIndex(memtable_rows)
    tables = -(-max(rows, 1) // memtable_rows)
    part = -(-tables // min(appends, tables)) * memtable_rows
    for first in range(0, max(rows, 1), part):
        index.append(entries, first, max(first + 1, min(first + part, rows)))
    hits = index.found()
    return index.compact().select("digest", "best", "n"), hits


def exact_duplicates(docs: DataFrame, digest=sha256_hex, memtable_rows: int = MEMTABLE_ROWS, appends: int = APPENDS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    digest: gives the index key of a normalised text; only tests use another than SHA-256.
    """
    return _classes(*numbered(docs.select("doc_id", "text")), digest, memtable_rows, appends).drop("row")


def _classes(docs: DataFrame, row: str, digest=sha256_hex, memtable_rows: int = MEMTABLE_ROWS, appends: int = APPENDS) -> DataFrame:
    """As exact_duplicates, of docs numbered in the column `row`, with those numbers as row."""
    text = docs.select(F.col(row).alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = text.select("row", "doc_id", F.char_length("text").cast("long").alias("n_chars"), normalised(F.col("text")).alias("norm"))
    log = stored(keyed.select("row", "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"), digest(F.col("norm")).alias("digest")), "digest-log")
    rows = log.count()
    index, hits = indexed(log, rows, memtable_rows, appends)
    norms = keyed.select(digest(F.col("norm")).alias("digest"), "norm")
    passing, others = parted(norms, "digest", hits, hits.count())
    if others is None:  # the filter would be too large to broadcast: the hits themselves decide
        passing = norms.join(hits, "digest", "left_semi")
    verified = passing.groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("most"))
    collided = stored(verified.where("least <> most").select("digest"), "digest-collisions")
    if not collided.isEmpty():  # equal digests of different texts: their index key is the text itself
        apart = keyed.select("row", digest(F.col("norm")).alias("digest"), "norm").join(collided, "digest").select("row", F.concat("digest", F.lit(":"), "norm").alias("exact"))
        log = stored(log.join(apart, "row", "left").withColumn("digest", F.coalesce("exact", "digest")).drop("exact"), "digest-log")
        index, _ = indexed(log, rows, memtable_rows, appends)
    both = join_classes(log, index, "digest", "n", rows)
    return both.select("row", "doc_id", F.col("best.doc_id").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs less all but one row of each group of equal texts."""
    rows, name = numbered(docs)
    return only_rows(rows, name, _classes(rows, name).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


ORACLE = r"""
WITH n AS (SELECT row_number() OVER () AS i, doc_id, length(coalesce(text, '')) AS c, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents),
g AS (SELECT t, count(*) AS group_size, min(struct_pack(a := -c, v := doc_id IS NULL, b := doc_id, i := i)) AS best FROM n GROUP BY t)
SELECT doc_id, best.b AS keep_id, CAST(group_size AS BIGINT) AS group_size, i = best.i AS kept, sha256(t) AS text_sha256
FROM n JOIN g USING (t)
"""
