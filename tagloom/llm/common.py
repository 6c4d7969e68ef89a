"""What the operators of this subpackage share: white space, shared tables, row numbers, filters."""

from __future__ import annotations

import ctypes
import functools
import json

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.sources.shared import discard, fresh_path, stored

__all__ = ["discard", "fresh_path", "stored"]

#: The characters that separate words: space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a regular expression class.
BLANK_CLASS = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def without_blanks(text: Column) -> Column:
    """Text less its word separators; plain replacements are much cheaper than a regular expression here."""
    for c in BLANKS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def words_of(text: Column) -> Column:
    """array<string> of words; null gives an empty array."""
    text = F.coalesce(text, F.lit(""))
    for c in BLANKS[1:]:
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def split_words(text: str | None) -> list[str]:
    """Python's twin of words_of: words between the six ASCII blanks only."""
    if not text:
        return []
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    for c in BLANKS[1:]:
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def quoted(name: str) -> str:
    """A column's name as an expression, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it while df already has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Files whose row counts one broadcast holds: 16 bytes each.
MOST_FILES = 1 << 20


def is_scan(df: DataFrame) -> bool:
    """Whether df is one scan of files, at most projected: then a file's name and a place in it name a row."""
    plan = df._jdf.queryExecution().analyzed()
    while plan.nodeName() in ("Project", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.nodeName() == "LogicalRelation"


def numbered(docs: DataFrame, most_files: int = MOST_FILES) -> tuple[DataFrame, str]:
    """docs with a last column of row numbers, from 0 without gaps, and that column's name.

    A number is the row's place in its file after the rows of the files before (by a hash of their names), so every scan of the
    result gives a row the same number, however the scan is split. What isn't a scan of Parquet files, or is one of more than
    most_files, is written once, and the rows of that table are numbered.
    """
    name = free_name(docs, "row")
    if is_scan(docs):
        meta = docs.metadataColumn("_metadata")
        file, place = F.xxhash64(meta["file_path"]), meta["row_index"]
        try:
            of_file = docs.groupBy(file.alias("file"), meta["file_path"].alias("path")).agg((F.max(place) + 1).alias("n"))
        except AnalysisException:  # no Parquet table
            of_file = None
        rows = of_file.select("file", "n").limit(most_files + 1).collect() if of_file is not None else None
        if rows is not None and len(rows) <= most_files and len({r.file for r in rows}) == len(rows):
            bases, at = [], 0
            for r in sorted(rows, key=lambda r: r.file):
                bases.append({"file": r.file, "base": at})
                at += r.n
            # at most most_files rows of 16 bytes; a literal, so that no executor runs Python for it
            table = docs.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(bases)), "array<struct<file:long,base:long>>")).alias("x"))
            of, index = free_name(docs, "__file"), free_name(docs, "__index")
            base = table.select(F.col("x.file").alias(of), F.col("x.base").alias("__base"))
            placed = docs.select("*", file.alias(of), place.alias(index)).join(F.broadcast(base), of)
            return placed.select(*(F.col(quoted(c)) for c in docs.columns), (F.col("__base") + F.col(index)).alias(name)), name
    return numbered(stored(docs.coalesce(max(1, most_files // 2)) if is_scan(docs) else docs, "rows"), most_files)


#: Bytes of the largest filter that is broadcast.
MOST_FILTER_BYTES = 64 << 20
#: Bits that one row of a filter holds (fixed by bitmap_construct_agg).
BITMAP_BITS = 32768


def filter_bits(n: int) -> int:
    """Bits of a filter of n keys: 16 to 31 for each, a power of two."""
    return max(BITMAP_BITS, 1 << (16 * max(n, 1)).bit_length())


def key_filter(keys: DataFrame, key: str, n: int) -> DataFrame:
    """bucket, bits: one bit for the hash of each of the n keys."""
    bit = F.xxhash64(key).bitwiseAND(F.lit(filter_bits(n) - 1))
    return keys.select(bit.alias("bit")).groupBy(F.shiftright("bit", 15).alias("bucket")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(BITMAP_BITS - 1))).alias("bits"))


def flagged(rows: DataFrame, key: str, bitmaps: DataFrame, n: int, flag: str) -> DataFrame:
    """rows with a boolean column: whether the key's bit is set in a filter of n keys. Nearly all other keys' bits aren't."""
    bit, bucket, bits = "__bit", "__bucket", "__bits"
    small = filter_bits(n) // 8 <= MOST_FILTER_BYTES
    maps = bitmaps.select(F.col("bucket").alias(bucket), F.col("bits").alias(bits))
    met = rows.withColumn(bit, F.xxhash64(key).bitwiseAND(F.lit(filter_bits(n) - 1))).withColumn(bucket, F.shiftright(bit, 15)).join(F.broadcast(maps) if small else maps, bucket, "left")
    at = F.col(bit).bitwiseAND(F.lit(BITMAP_BITS - 1))
    octet = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = octet.bitwiseAND(F.expr(f"shiftleft(1, cast({bit} % 8 as int))")) != 0
    return met.withColumn(flag, F.coalesce(is_set, F.lit(False))).drop(bit, bucket, bits)


def parted(rows: DataFrame, key: str, keys: DataFrame, n: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key may be among the n keys of keys(key), the other rows), so that the others needn't be shuffled to meet them.
    Where the filter would be too large to broadcast, all rows are in the first part and the second is None."""
    if filter_bits(n) // 8 > MOST_FILTER_BYTES:
        return rows, None
    flag = free_name(rows, "__flag")
    both = flagged(rows, key, key_filter(keys, keys.columns[0], n), n, flag)
    return both.where(F.col(flag)).drop(flag), both.where(~F.col(flag)).drop(flag)


def only_rows(docs: DataFrame, name: str, rows: DataFrame) -> DataFrame:
    """docs, numbered in the column `name`, less that column and all rows whose number isn't in rows(row).

    Texts that stay aren't shuffled: a filter of the numbers that go tells nearly all of them, and only what it lets through meets those numbers."""
    dropped = stored(docs.select(name).join(rows.select(F.col("row").alias(name)), name, "left_anti"), "dropped-rows")
    passing, others = parted(docs, name, dropped, dropped.count())
    out = passing.join(dropped, name, "left_anti")
    return (out if others is None else out.unionByName(others)).drop(name)


def join_classes(rows: DataFrame, classes: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """rows joined with their class (one row per key; n: rows of that key). Keys with over a thousandth of all rows, of which
    there are fewer than 1,000, are met by broadcast and never shuffled; the others by a shuffled join."""
    least = max(1, total // 1000)
    others = [c for c in classes.columns if c != key]
    renamed = {c: f"__{c}" for c in others}
    large = classes.where(F.col(n) > least).withColumnsRenamed(renamed)
    hot = rows.join(F.broadcast(large), key, "left")
    met = hot.where(F.col(f"__{n}").isNotNull()).withColumnsRenamed({v: k for k, v in renamed.items()})
    rest = hot.where(F.col(f"__{n}").isNull()).drop(*renamed.values())
    return met.unionByName(rest.join(classes.where(F.col(n) <= least), key))


def positional(df: DataFrame) -> DataFrame:
    """df with columns c0, c1, ...: mapInArrow can't resolve names that hold points."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


@functools.cache
def _trim():
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def releasing(run):
    """run, a function for mapInArrow, that gives its free memory back to the system at its end: workers live on after a task."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return wrapped
