"""Removal of passages that repeat, found by fixed-block anchors.

A window of WINDOW words that starts anywhere in a document holds exactly one whole block of ANCHOR words that starts at a
multiple of ANCHOR. These non-overlapping blocks are the index; every rolling window of ANCHOR words probes it.

1. Each task cuts its texts into chunks, hashes a chunk's blocks and all its rolling windows and sends them, by hash range and as
   sorted, packed arrays (about two bytes a window): a key of any frequency once a chunk. A block that starts again in its
   own chunk is a hit there and then, so a passage that most documents share never meets in one place.
2. Each hash range tells which of the other blocks start in other chunks as well; these are hits for their documents.
3. Around the hits of a document, the windows of WINDOW words are grouped in its chunk by two hashes (96 bits) and compared
   word by word with the first of their group; windows that occur twice in a chunk are repeats. For the others, ranges of hashes
   find an occurrence in another chunk, the partner.
4. Hits are extended: windows whose partners follow each other in one document make a stretch, which is compared, word by word, with
   the partner's own words. A chain of proven windows is a maximal repeat, and its words go.

Only texts with hits move to meet them, once for the windows and once for the removal. No pair of documents is ever formed,
and nothing is removed by its hash alone: two different windows of one hash, of which there are under 1e-9 in 10**10, end
the job with an error that asks for another seed.

Ranges are as many as the words need (WORDS_PER_RANGE, of which a task holds about 12 bytes each), up to one for every 16 words of
a chunk; beyond about 10**11 words larger chunks (4 GB of memory for each worker at 100 TB) keep messages that long.

Defined cases: null and blank texts have no words; a document shorter than WINDOW words keeps all; a repeated row is another
document and repeats all of the first; null doc_ids are kept as they are; overlapping windows of one document count as two.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import discard, numbered, parted, positional, quoted, releasing, split_words, stored

WINDOW = 35
#: The longest block of which one lies whole in any window, wherever that starts.
ANCHOR = (WINDOW + 1) // 2
#: Words whose windows a task packs at once.
CHUNK_WORDS = 750_000
#: Different words that a task remembers.
WORDS_HELD = 250_000
#: Hash ranges: at least so many, and one for so many words.
RANGES, WORDS_PER_RANGE = 64, 4_000_000
#: Stretches that ask for the words of one document in one task.
ASKED = 4096
SEED = 0
_codec = pa.Codec("zstd", 1)


def base(seed: int, k: int) -> np.uint64:
    """One of two odd multipliers of a rolling hash, for each seed others."""
    fixed = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)[k]
    return np.uint64((fixed + 2 * seed * 0xA0761D6478BD642F) % (1 << 64))


def squeezed(values: np.ndarray) -> bytes:
    """Packed: byte k of all values stands together, so the bytes that hardly differ take no room."""
    data = np.ascontiguousarray(values)
    planes = data.view(np.uint8).reshape(-1, data.itemsize).T.tobytes()
    return len(planes).to_bytes(8, "little") + _codec.compress(planes, asbytes=True) if planes else b""


def unsqueezed(data: bytes, dtype) -> np.ndarray:
    if not data:
        return np.empty(0, dtype)
    size = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(_codec.decompress(data[8:], size), np.uint8)
    return np.ascontiguousarray(planes.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class WordHashes:
    """Two hashes of each word; words are numbered as they come, and forgotten together."""

    def __init__(self, seed: int = SEED):
        self.seed = seed
        self.number: dict[str, int] = {}
        self.hashes = (array("Q"), array("Q"))

    def trim(self) -> None:
        if len(self.number) > WORDS_HELD:
            self.__init__(self.seed)

    def numbers(self, words: list[str]) -> np.ndarray:
        number = self.number
        for w in {*words}.difference(number):
            digest = xxhash.xxh3_128_intdigest(w, self.seed)
            number[w] = len(number)
            self.hashes[0].append(digest & 0xFFFFFFFFFFFFFFFF)
            self.hashes[1].append(digest >> 64)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def of(self, numbers: np.ndarray, k: int) -> np.ndarray:
        return np.frombuffer(self.hashes[k], np.uint64)[numbers] if len(numbers) else np.empty(0, np.uint64)


def _summed(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial in base of each n consecutive words. No closure: one that calls itself would hold words until a collection of cycles."""
    if n == 1:
        return words
    half = n // 2
    left = _summed(words, half, base)
    right = left if n == 2 * half else _summed(words, n - half, base)
    m = max(0, len(words) - n + 1)
    out = left[:m] * np.uint64(pow(int(base), n - half, 1 << 64))
    out += right[half : half + m]
    return out


def rolled(words: np.ndarray, n: int, base: np.uint64) -> np.ndarray:
    """Polynomial hash of each n consecutive words, mixed so that all bits count."""
    x = _summed(words, n, base)
    x = x.copy() if x is words else x
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(29)
    return x


class Chunk:
    """Words of consecutive texts, one after the other."""

    def __init__(self, seed: int = SEED):
        self.words = WordHashes(seed)
        self.clear()

    def clear(self) -> None:
        self.words.trim()
        self.rows, self.parts, self.extra, self.n = [], [], [], 0

    def add(self, row: int, text: str | None, extra=None) -> None:
        self.parts.append(self.words.numbers(split_words(text)))
        self.rows.append(row)
        self.extra.append(extra)
        self.n += len(self.parts[-1])

    def laid_out(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts; of each text its start and length."""
        length = np.array([len(p) for p in self.parts], np.int64)
        return np.concatenate(self.parts), np.cumsum(length) - length, length


def chunked(batches, pack, chunk_words: int, seed: int):
    """Packs texts (row, text and what else there is) by chunks: pack(chunk, its name, its number)."""
    context = TaskContext.get()
    chunk, name, n = Chunk(seed), (context.partitionId() if context else 0) << 32, 0
    for batch in batches:
        extra = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
        for row, text, more in zip(batch.column(0).to_pylist(), batch.column(1), extra, strict=True):
            chunk.add(row, text.as_py(), more)
            if chunk.n >= chunk_words:
                yield pack(chunk, name + n, (name >> 32) + n)
                n += 1
                chunk.clear()
    if chunk.n:
        yield pack(chunk, name + n, (name >> 32) + n)


def by_range(keys: np.ndarray, ranges: int) -> np.ndarray:
    return (keys >> np.uint64(32)) % np.uint64(ranges)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    """Schema of "name type, ..." with the types that are used here."""
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, types[kind]) for name, kind in (x.split(" ") for x in ddl.split(", "))])


ANCHORS = "bucket int, probes binary, often binary, blocks binary, rows binary, numbers binary"


def send_anchors(ranges: int, chunk_words: int = CHUNK_WORDS, seed: int = SEED):
    """For mapInArrow: (row, text) -> packed probes and blocks of each hash range, and hits (rows and numbers only) for any range."""

    def pack(chunk: Chunk, _name: int, n: int):
        numbers, start, length = chunk.laid_out()
        hashes = rolled(chunk.words.of(numbers, 0), ANCHOR, base(seed, 0))
        text = np.repeat(np.arange(len(length)), length)[: len(hashes)]
        at = np.arange(len(hashes)) - start[text]
        whole = at + ANCHOR <= length[text]
        keys = by_range(hashes, ranges) << np.uint64(32) | hashes & np.uint64(0xFFFFFFFF)
        probes, count = np.unique(keys[whole], return_counts=True)
        blocks = np.flatnonzero(whole & (at % ANCHOR == 0))
        probe = np.searchsorted(probes, keys[blocks])  # a block is a window too
        rows, block = np.array(chunk.rows, np.int64)[text[blocks]], (at[blocks] // ANCHOR).astype(np.uint32)
        again = count[probe] > 1
        alone = np.flatnonzero(~again)
        alone = alone[np.argsort(probe[alone])]
        sent = probes[probe[alone]]
        edges = np.arange(ranges + 1, dtype=np.uint64) << np.uint64(32)
        cut, cut_sent = np.searchsorted(probes, edges), np.searchsorted(sent, edges)
        low = lambda x: np.diff(x.astype(np.uint32), prepend=np.uint32(0))
        out = []
        for r in np.flatnonzero(np.diff(cut)).tolist():
            p, b = slice(cut[r], cut[r + 1]), slice(cut_sent[r], cut_sent[r + 1])
            out.append((r, squeezed(low(probes[p])), np.packbits(count[p] > 1).tobytes(), squeezed(low(sent[b])), squeezed(rows[alone[b]]), squeezed(block[alone[b]])))
        if again.any():
            out.append((n % ranges, b"", b"", b"", squeezed(rows[again]), squeezed(block[again])))
        return _batch(out, _arrow(ANCHORS))

    def run(batches):
        yield from chunked(batches, pack, chunk_words, seed)

    return run


HITS = "row long, block int"


def hit_blocks(batches):
    """For mapInArrow, a partition being a hash range: blocks that start at least twice -> (row, block)."""
    probes, often, blocks, rows, numbers = [], [], [], [], []
    undo = lambda x: np.cumsum(unsqueezed(x, np.uint32), dtype=np.uint32)
    out = lambda rows, numbers: pa.RecordBatch.from_arrays([pa.array(rows), pa.array(numbers.astype(np.int32))], schema=_arrow(HITS))
    for batch in batches:
        for r in batch.to_pylist():
            if not r["probes"]:
                yield out(unsqueezed(r["rows"], np.int64), unsqueezed(r["numbers"], np.uint32))
                continue
            probes.append(undo(r["probes"]))
            often.append(np.unpackbits(np.frombuffer(r["often"], np.uint8), count=len(probes[-1])).astype(bool))
            blocks.append(undo(r["blocks"]))
            rows.append(r["rows"])
            numbers.append(r["numbers"])
    if not probes:
        return
    again = [p[o] for p, o in zip(probes, often, strict=True)]
    all_ = np.sort(np.concatenate(probes))
    del probes, often
    repeated = np.unique(np.concatenate([all_[1:][all_[1:] == all_[:-1]], *again]))
    del all_
    for b, r, n in zip(blocks, rows, numbers, strict=True):
        at = np.searchsorted(repeated, b)
        hit = np.flatnonzero(at < len(repeated))
        hit = hit[repeated[at[hit]] == b[hit]]
        if len(hit):
            yield out(unsqueezed(r, np.int64)[hit], unsqueezed(n, np.uint32)[hit])


WINDOWS = "bucket int, chunk long, a binary, b binary, alone binary, rows binary, places binary"


def _different() -> ValueError:
    return ValueError("two different windows share their hashes: give another seed")


def send_windows(ranges: int, chunk_words: int = CHUNK_WORDS, seed: int = SEED):
    """For mapInArrow: (row, text, hits) -> packed windows around the hits, by hash range, one of each kind; and all windows that
    occur twice in the chunk (rows and places only) for any range."""

    def pack(chunk: Chunk, name: int, n: int):
        numbers, start, length = chunk.laid_out()
        first, second = (rolled(chunk.words.of(numbers, k), WINDOW, base(seed, k)) for k in (0, 1))
        # a window is looked at if its one whole block is a hit: it starts at most WINDOW - ANCHOR words before that
        hits = np.concatenate([s + np.asarray(h, np.int64) * ANCHOR for s, h in zip(start, chunk.extra, strict=True)])
        marks = np.zeros(len(numbers) + 1, np.int64)
        own = np.searchsorted(start, hits, "right") - 1
        np.add.at(marks, np.maximum(start[own], hits - (WINDOW - ANCHOR)), 1)
        np.add.at(marks, hits + 1, -1)
        at = np.flatnonzero(np.cumsum(marks[: len(first)]) > 0)
        text = np.searchsorted(start, at, "right") - 1
        fits = at - start[text] + WINDOW <= length[text]
        at, text = at[fits], text[fits]
        a, b = first[at], (second[at] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        bucket = by_range(a, ranges)
        order = np.lexsort((b, a, bucket))
        at, text, a, b, bucket = at[order], text[order], a[order], b[order], bucket[order]
        new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.empty(0, bool)
        heads = np.flatnonzero(new)
        times = np.diff(np.append(heads, len(a)))
        rows, where = np.array(chunk.rows, np.int64)[text], (at - start[text]).astype(np.uint32)
        twice = np.flatnonzero(np.repeat(times, times) > 1)
        mine, model = at[twice], at[np.repeat(heads, times)[twice]]
        for k in range(WINDOW):  # word by word; numbers stand for words
            if (numbers[mine + k] != numbers[model + k]).any():
                raise _different()
        cut = np.searchsorted(bucket[heads], np.arange(ranges + 1, dtype=np.uint64))
        out = []
        for r in np.flatnonzero(np.diff(cut)).tolist():
            h = heads[cut[r] : cut[r + 1]]
            out.append((r, name, squeezed(a[h]), squeezed(b[h]), np.packbits(times[cut[r] : cut[r + 1]] == 1).tobytes(), squeezed(rows[h]), squeezed(where[h])))
        if len(twice):
            out.append((n % ranges, name, b"", b"", b"", squeezed(rows[twice]), squeezed(where[twice])))
        return _batch(out, _arrow(WINDOWS))

    def run(batches):
        yield from chunked(batches, pack, chunk_words, seed)

    return run


PARTNERS = "chunk long, rows binary, places binary, p_rows binary, p_places binary"


def partners(batches):
    """For mapInArrow, a partition being a hash range: of the windows that are alone in their chunk, those that occur in another
    one as well, with an occurrence there; the windows that occur twice in their chunk pass through, without a partner."""
    held = []
    for batch in batches:
        for r in batch.to_pylist():
            if r["a"]:
                held.append(r)
            else:
                yield _batch([(r["chunk"], r["rows"], r["places"], b"", b"")], _arrow(PARTNERS))
    if not held:
        return
    a = np.concatenate([unsqueezed(r.pop("a"), np.uint64) for r in held])
    parts = [unsqueezed(r.pop("b"), np.uint32) for r in held]
    size, b = [len(x) for x in parts], np.concatenate(parts)
    alone = np.concatenate([np.unpackbits(np.frombuffer(r.pop("alone"), np.uint8), count=n) for r, n in zip(held, size, strict=True)]).astype(bool)
    rows = np.concatenate([unsqueezed(r.pop("rows"), np.int64) for r in held])
    places = np.concatenate([unsqueezed(r.pop("places"), np.uint32) for r in held])
    # the first occurrence of a kind is the partner of all others, the second that of the first: neighbours share a document
    order = np.lexsort((places, rows, b, a))
    new = np.concatenate(([True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])))
    del a, b, parts
    heads = np.flatnonzero(new)
    times = np.diff(np.append(heads, len(order)))
    first = np.repeat(heads, times)
    partner = np.where(new, np.minimum(first + 1, len(order) - 1), first)
    met = np.empty(len(order), np.int64)
    met[order] = np.where(np.repeat(times, times) > 1, order[partner], -1)
    lo = 0
    for r, n in zip(held, size, strict=True):
        hit = lo + np.flatnonzero(alone[lo : lo + n] & (met[lo : lo + n] >= 0))
        lo += n
        if len(hit):
            hit = hit[np.lexsort((places[hit], rows[hit]))]
            other = met[hit]
            yield _batch([(r["chunk"], squeezed(rows[hit]), squeezed(places[hit]), squeezed(rows[other]), squeezed(places[other]))], _arrow(PARTNERS))


MARKS = "row long, spans array<int>, stretches array<long>"


def marks_of(batches):
    """For mapInArrow, a chunk's records together -> MARKS: starts and ends of proven repeats, and stretches (start, windows, partner's
    row and start) that are yet to be compared."""

    def ragged(rows: np.ndarray, of: np.ndarray, values: np.ndarray) -> pa.ListArray:
        """Of each of rows, the values (some for each entry of `of`, which is sorted)."""
        ends = np.searchsorted(of, rows, "right") * values.shape[1]
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(values.ravel()))

    def made(proven: list, single: list) -> pa.RecordBatch:
        rows, places = (np.concatenate([x[k] for x in proven]) if proven else np.empty(0, np.int64) for k in (0, 1))
        order = np.lexsort((places, rows))
        rows, places = rows[order], places[order]
        begins = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]) | (places[1:] > places[:-1] + WINDOW)))) if len(rows) else np.empty(0, np.int64)
        last = np.append(begins[1:], len(rows))[: len(begins)] - 1
        spans = np.stack([places[begins], places[last] + WINDOW], 1).astype(np.int32)
        r, p, pr, pp = (np.concatenate([x[k] for x in single]) if single else np.empty(0, np.int64) for k in range(4))
        order = np.lexsort((p, r))
        r, p, pr, pp = r[order], p[order], pr[order], pp[order]
        starts = np.flatnonzero(np.concatenate(([True], (r[1:] != r[:-1]) | (p[1:] != p[:-1] + 1) | (pr[1:] != pr[:-1]) | (pp[1:] != pp[:-1] + 1)))) if len(r) else np.empty(0, np.int64)
        n = np.diff(np.append(starts, len(r)))
        stretches = np.stack([p[starts], n, pr[starts], pp[starts]], 1)
        every = np.union1d(rows[begins], r[starts])
        return pa.RecordBatch.from_arrays([pa.array(every), ragged(every, rows[begins], spans), ragged(every, r[starts], stretches)], names=["row", "spans", "stretches"])

    chunk, proven, single = None, [], []
    for batch in batches:
        for x in batch.to_pylist():
            if x["chunk"] != chunk and (proven or single):
                yield made(proven, single)
                proven, single = [], []
            chunk = x["chunk"]
            own = unsqueezed(x["rows"], np.int64), unsqueezed(x["places"], np.uint32).astype(np.int64)
            if x["p_rows"]:
                single.append((*own, unsqueezed(x["p_rows"], np.int64), unsqueezed(x["p_places"], np.uint32).astype(np.int64)))
            else:
                proven.append(own)
    if proven or single:
        yield made(proven, single)


ANSWERS = "row long, lo int, words string"


def answers(batches):
    """For mapInArrow: (text, asked) -> the words at each asked place, for the row that asks."""
    for batch in batches:
        out, held = [], 0
        for text, asked in zip(batch.column(0), batch.column(1), strict=True):
            words = split_words(text.as_py())
            for x in asked.as_py():
                out.append((x["row"], x["lo"], " ".join(words[x["p_lo"] : x["p_lo"] + x["n"] + WINDOW - 1])))
                held += len(out[-1][2])
                if held > 8 << 20:
                    yield _batch(out, _arrow(ANSWERS))
                    out, held = [], 0
        if out:
            yield _batch(out, _arrow(ANSWERS))


def repeats(docs: DataFrame, row: str, chunk_words: int = CHUNK_WORDS, seed: int = SEED) -> tuple[DataFrame, DataFrame, int]:
    """Of docs numbered in the column `row`: marks (a stored table MARKS of the rows that repeat in part), the partners' words (row,
    answers) and the number of marks."""
    spark = docs.sparkSession
    texts = docs.select(F.col(quoted(row)).alias("row"), "text")
    words = (texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    ranges = max(RANGES, int(spark.conf.get("spark.sql.shuffle.partitions")), min(words // WORDS_PER_RANGE, chunk_words // 16))
    anchors = texts.mapInArrow(releasing(send_anchors(ranges, chunk_words, seed)), ANCHORS)
    hits = anchors.repartitionById(ranges, "bucket").mapInArrow(releasing(hit_blocks), HITS).groupBy("row").agg(F.collect_list("block").alias("hits"))
    hits = stored(hits, "repeat-hits")
    few, _ = parted(texts, "row", hits.select("row"), hits.count())
    windows = few.join(hits, "row").select("row", "text", "hits").mapInArrow(releasing(send_windows(ranges, chunk_words, seed)), WINDOWS)
    found = windows.repartitionById(ranges, "bucket").mapInArrow(releasing(partners), PARTNERS)
    marks = stored(found.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(releasing(marks_of), MARKS), "repeat-marks")
    discard(hits)
    n, n_asked = marks.agg(F.count("*"), F.coalesce(F.sum(F.expr("size(stretches) div 4")), F.lit(0))).first()
    each = "transform(sequence(0, size(stretches) div 4 - 1), i -> struct(row, int(stretches[4 * i]) as lo, int(stretches[4 * i + 1]) as n, stretches[4 * i + 2] as p_row, int(stretches[4 * i + 3]) as p_lo))"
    asked = marks.where("size(stretches) > 0").select(F.expr(f"explode({each})").alias("x")).select("x.*")
    # a document that many ask is asked in several groups
    load = asked.groupBy("p_row").agg(F.ceil(F.count("*") / ASKED).alias("groups"))
    dealt = asked.join(load, "p_row").groupBy("p_row", F.pmod(F.xxhash64("row", "lo"), "groups").alias("group")).agg(F.collect_list(F.struct("row", "lo", "n", "p_lo")).alias("asked"))
    sources, _ = parted(texts, "row", asked.select("p_row"), n_asked)
    told = sources.join(dealt, F.col("row") == F.col("p_row")).select("text", "asked").mapInArrow(releasing(answers), ANSWERS)
    return marks, told.groupBy("row").agg(F.collect_list(F.struct("lo", "words")).alias("answers")), n


def marked(docs: DataFrame, chunk_words: int = CHUNK_WORDS, seed: int = SEED) -> DataFrame:
    """docs with two last columns: spans and answers. Rows without either aren't shuffled."""
    rows, row = numbered(docs)
    marks, told, n = repeats(rows, row, chunk_words, seed)
    found = marks.select("row", "spans").join(told, "row", "left").select(F.col("row").alias("__marked"), F.col("spans").alias("__spans"), F.col("answers").alias("__answers"))
    passing, others = parted(rows, row, marks.select("row"), n)
    out = passing.join(found, F.col(quoted(row)) == F.col("__marked"), "left").drop(row, "__marked")
    if others is not None:
        out = out.unionByName(others.drop(row).withColumns({"__spans": F.lit(None).cast("array<int>"), "__answers": F.lit(None).cast("array<struct<lo:int,words:string>>")}))
    return out


def left_over(words: list[str], spans: list[int] | None, told: list[dict] | None) -> list[str]:
    """words less those of the spans and of the stretches, once these are what the partner has."""
    gone = list(zip(spans[::2], spans[1::2], strict=True)) if spans else []
    for x in told or ():
        theirs = x["words"].split(" ")
        if words[x["lo"] : x["lo"] + len(theirs)] != theirs:
            raise _different()
        gone.append((x["lo"], x["lo"] + len(theirs)))
    kept, at = [], 0
    for lo, hi in sorted(gone):
        kept += words[at:lo] if lo > at else ()
        at = max(at, hi)
    return kept + words[at:] if gone else words


def kept_words(batches):
    """For mapInArrow: (doc_id, text, spans, answers) -> KEPT."""
    for batch in batches:
        n, removed, kept = [], [], []
        for text, spans, told in zip(batch.column(1), batch.column(2), batch.column(3), strict=True):
            words = split_words(text.as_py())
            left = left_over(words, spans.as_py(), told.as_py())
            n.append(len(words))
            removed.append(len(words) - len(left))
            kept.append(" ".join(left))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])


KEPT = "doc_id long, n_words long, n_removed long, kept string"


def without_repeats(docs: DataFrame, chunk_words: int = CHUNK_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) of each row of docs."""
    return marked(docs.select("doc_id", "text"), chunk_words, seed).mapInArrow(releasing(kept_words), KEPT)


def drop_repeats(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with texts less their repeats (n_chars, if there, follows); texts without repeats stay as they are."""
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches):
        for batch in batches:
            *columns, spans, told = batch.columns
            texts, sizes = columns[at].to_pylist(), columns[chars].to_pylist() if chars is not None else None
            for k, (s, t) in enumerate(zip(spans.to_pylist(), told.to_pylist(), strict=True)):
                if s or t:
                    texts[k] = " ".join(left_over(split_words(texts[k]), s, t))
                    if sizes:
                        sizes[k] = len(texts[k])
            columns[at] = pa.array(texts, pa.string())
            if sizes:
                columns[chars] = pa.array(sizes, columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return positional(marked(docs, seed=seed)).mapInArrow(releasing(run), docs.schema)


def with_digest(batches):
    for batch in kept_words(batches):
        digests = [hashlib.sha256(t.as_py().encode()).hexdigest() for t in batch.column(3)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(digests, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return marked(docs.select("doc_id", "text")).mapInArrow(releasing(with_digest), "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
v AS (SELECT doc_id, i, word, count(*) OVER w AS m, string_agg(word, ' ') OVER w AS win FROM p
      WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
r AS (SELECT doc_id, i, word, m = {WINDOW} AND count(*) OVER (PARTITION BY win) > 1 AS rep FROM v),
c AS (SELECT doc_id, i, word, max(CAST(rep AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM r),
s AS (SELECT doc_id, CAST(sum(gone) AS BIGINT) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (gone = 0), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN s ON s.doc_id = d.doc_id
"""
