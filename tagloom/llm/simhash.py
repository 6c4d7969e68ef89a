"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprint: 64 bits of the shingles' XXH64 by majority. Equal fingerprints become one node with its least doc_id.
2. Blocks: within RADIUS bits of 64, at least one of four 16-bit parts is equal, and of the other 48 bits at least one of
   four 12-bit parts. So two linked fingerprints meet under at least one of 16 keys of 28 bits; the sets are complete.
3. A block's fingerprints are stored as 64 bit planes (bit j of all of them in plane j). Shifting a plane by d compares every
   fingerprint with the d-th after it: the XOR of planes feeds carry-save counters, bit by bit, for 64 pairs a word. Counters
   that pass the radius stay so; once all pairs of a stretch have passed it, the stretch is abandoned.
4. Only links that join two trees of a block's forest are emitted, never all pairs; pairs that are in one tree already aren't
   looked at, and a block that is one tree is done. Components come from tables.

A block of more than TILE fingerprints is cut by further keys: of its other 36 bits, one of four parts of 9 bits is equal as well.
What is still larger is cut into slices, and each pair of slices is a task of its own, so no task holds an unbounded block.

Defined cases: null and blank texts have fingerprint zero and link like any other; fewer words than a shingle form one
shingle; null doc_ids count as greater than all others when a component is named (a component of null doc_ids only has a
null id); repeated rows share a component. A text of any length is hashed whole, with 8 bytes a word held beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import discard, join_classes, numbered, only_rows, releasing, split_words, stored
from tagloom.llm.components import components

RADIUS = 3
SHINGLE = 3
SEED = 42
#: Fingerprints of one block that one task compares.
TILE = 16_384
#: Words of 64 pairs in a stretch that is abandoned as one.
STRETCH = 64
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of each shingle, repeats included."""
    w = split_words((text or "").lower() if (text or "").isascii() else (text or "").translate(LOWER))
    if not w:
        return np.empty(0, "<u8")
    joined = [" ".join(w)] if len(w) < shingle else map(" ".join, zip(*(w[k:] for k in range(shingle))))  # noqa: B905
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, SEED) for s in joined], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 16384):  # bounds the unpacked bits of a long text
        part = hashes[lo : lo + 16384]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, row: str, shingle: int = SHINGLE) -> DataFrame:
    """row, doc_id, fp (the fingerprint as a signed long) of each row of docs, which has its number in the column `row`."""

    def run(batches):
        for batch in batches:
            fp = [_signed(fingerprint(t.as_py(), shingle)) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], names=["row", "doc_id", "fp"])

    return docs.select(F.col(row).alias("row"), "doc_id", "text").mapInArrow(releasing(run), "row long, doc_id long, fp long")


def _cut(bits: list[int], radius: int) -> list[list[int]]:
    """radius + 1 parts of the bits: two fingerprints within the radius agree in one of them."""
    return [bits[len(bits) * k // (radius + 1) : len(bits) * (k + 1) // (radius + 1)] for k in range(radius + 1)]


def keys(radius: int = RADIUS) -> list[tuple[int, list[int]]]:
    """(number, bits) of the keys: one of radius + 1 parts of all bits, and one of radius + 1 parts of the others."""
    found = []
    for first in _cut(list(range(64)), radius):
        rest = [b for b in range(64) if b not in first]
        found += [sorted(first + second) for second in _cut(rest, radius)]
    return list(enumerate(found))


def _masked(bits: list[int]) -> int:
    return _signed(sum(1 << b for b in bits))


def blocks(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """key, part, fp: each fingerprint under each of its keys."""
    each = F.array(*(F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(_masked(bits))).alias("key")) for k, bits in keys(radius)))
    return nodes.select("fp", F.explode(each).alias("k")).select("k.part", "k.key", "fp")


def bit_planes(fp: np.ndarray) -> np.ndarray:
    """Row j: bit j of all fingerprints, 64 of them a word."""
    n = -(-len(fp) // 64) * 64
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    padded = np.zeros((64, n), np.uint8)
    padded[:, : len(fp)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view("<u8")


def _shifted(planes: np.ndarray, d: int) -> np.ndarray:
    """Planes whose position p holds what planes hold at p + d."""
    words_, bits = divmod(d, 64)
    out = np.zeros_like(planes)
    if words_ < planes.shape[-1]:
        out[..., : planes.shape[-1] - words_] = planes[..., words_:]
    if bits:
        low = out >> np.uint64(bits)
        low[..., :-1] |= out[..., 1:] << np.uint64(64 - bits)
        return low
    return out


def within(mine: np.ndarray, other: np.ndarray, alive: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Bits of the pairs (same positions of two sets of planes) at radius or less; alive: the pairs to look at.

    Carry-save counters: ones, twos, ... hold the count's bits, `over` the pairs that have passed the radius. Stretches in
    which every pair has are dropped from the work at each eighth plane.
    """
    width = (radius + 1).bit_length()
    result = np.zeros_like(alive)
    pad = -len(alive) % STRETCH
    at = np.flatnonzero(np.pad(alive, (0, pad)).reshape(-1, STRETCH).any(1))
    if not len(at):
        return result
    places = (at[:, None] * STRETCH + np.arange(STRETCH)).ravel()
    places = places[places < len(alive)]
    over = ~alive[places]
    counters = [np.zeros(len(places), np.uint64) for _ in range(width)]
    for j in range(64):
        carry = (mine[j, places] ^ other[j, places]) & ~over
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= _at_least(counters, radius + 1)
        if j % 8 == 7 and j < 63:
            live = np.flatnonzero(over != np.uint64(0xFFFFFFFFFFFFFFFF))
            if not len(live):
                return result
            if len(live) < len(over) // 2:
                places, over, counters = places[live], over[live], [c[live] for c in counters]
    result[places] = ~over
    return result


def _at_least(counters: list[np.ndarray], least: int) -> np.ndarray:
    """Bits of the counters that hold least or more."""
    greater = np.zeros_like(counters[0])
    equal = ~greater
    for k in range(len(counters) - 1, -1, -1):
        if least >> k & 1:
            equal = equal & counters[k]
        else:
            greater |= equal & counters[k]
            equal = equal & ~counters[k]
    return greater | equal


class Forest:
    """Union-find over positions; join() tells whether a link joins two trees."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def labels(self) -> np.ndarray:
        """The root of every position."""
        while True:
            above = self.up[self.up]
            if (above == self.up).all():
                return above
            self.up = above


def _set_bits(words_: np.ndarray) -> np.ndarray:
    some = np.flatnonzero(words_)
    bits = np.unpackbits(words_[some].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    r, c = np.nonzero(bits)
    return some[r] * 64 + c


def _pack(bits: np.ndarray) -> np.ndarray:
    return np.packbits(np.pad(bits, (0, -len(bits) % 64)), bitorder="little").view("<u8")


def links_of(group: np.ndarray, side: np.ndarray, fp: np.ndarray, radius: int = RADIUS, check=None) -> tuple[np.ndarray, np.ndarray]:
    """Links (as positions) that span all components of every group. Rows of a group stand together, distinct fingerprints each.

    side: 0 and 1 for the two slices of a tile, whose pairs across are compared; -1 where all pairs are. check: of two positions
    within the radius, whether they are linked; None: they are.
    """
    n = len(fp)
    forest, found = Forest(n), []
    label = np.arange(n)
    first = np.concatenate(([True], group[1:] != group[:-1]))
    of = np.cumsum(first) - 1  # each row's group
    size = np.bincount(of)
    trees = size.copy()  # of each group; 1: done
    rest, d = np.arange(n), 1
    mine, own, sides = bit_planes(fp), of, side
    while True:
        keep = (size[own] > d) & (trees[own] > 1)
        if not keep.any():
            break
        if keep.sum() < 0.8 * len(rest):
            rest = rest[keep]
            mine, own, sides = bit_planes(fp[rest]), of[rest], side[rest]
        same = np.zeros(len(rest), np.uint8)
        at = label[rest]
        same[:-d] = (own[:-d] == own[d:]) & (at[:-d] != at[d:]) & ((sides[:-d] < 0) | (sides[:-d] != sides[d:]))
        hit = _set_bits(within(mine, _shifted(mine, d), _pack(same), radius))
        before = len(found)
        for a, b in zip(rest[hit].tolist(), rest[hit + d].tolist(), strict=True):
            if forest.root(a) != forest.root(b) and (check is None or check(a, b)):
                forest.join(a, b)
                found.append((a, b))
                trees[of[a]] -= 1
        if len(found) > before:
            label = forest.labels()
        d += 1
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def compare(batches):
    """For mapInArrow: rows (tile, side, fp), each tile's together -> links (a, b). Holds whole tiles only."""

    def out(tile, side, fp):
        a, b = links_of(tile, side, fp.view(np.uint64))
        return pa.RecordBatch.from_arrays([pa.array(fp[a]), pa.array(fp[b])], names=["a", "b"])

    held = [np.empty(0, np.int64)] * 3
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)]
        held = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if len(held[0]) < TILE:
            continue
        whole = int(np.searchsorted(held[0], held[0][-1]))  # where the last tile begins
        if whole:
            yield out(*(x[:whole] for x in held))
            held = [x[whole:] for x in held]
    if len(held[0]):
        yield out(*held)


def links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """a, b: fingerprints of nodes(fp, distinct) whose components are those of all links."""
    by = ["part", "key", "sub", "subkey"]
    member = blocks(nodes, radius).withColumns({"sub": F.lit(-1), "subkey": F.lit(0).cast("long")})
    sizes = lambda rows: stored(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1"), "simhash-blocks")
    place = [F.col(c).cast("long").alias(c) for c in by]
    none = F.lit(-1).cast("long")
    whole = lambda met: met.where(F.col("n") <= tile).select(*place, none.alias("i"), none.alias("j"), none.alias("side"), "fp")
    of_key = sizes(member)
    met = member.join(of_key, by)
    tiles = whole(met)
    if not of_key.where(F.col("n") > tile).isEmpty():
        # a large block once more by the parts of its other bits: four copies of each fingerprint
        masks = F.array(*(F.array(*(F.lit(_masked(part)) for part in _cut([b for b in range(64) if b not in bits], radius))) for _, bits in keys(radius)))
        subkeys = F.posexplode(F.transform(masks[F.col("part")], lambda m: F.col("fp").bitwiseAND(m)))
        large = met.where(F.col("n") > tile).select("part", "key", "fp", subkeys.alias("sub", "subkey"))
        fine = large.join(sizes(large), by)
        # slice i of what is still large meets each slice j: rows of a slice go to as many tiles as there are slices
        slices = F.ceil(F.col("n") / (tile // 2))
        cut = fine.where(F.col("n") > tile).withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("fp"), slices))
        many = cut.withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))).select(
            *place, F.least("slice", "o").alias("i"), F.greatest("slice", "o").alias("j"),
            F.when(F.col("slice") == F.col("o"), -1).when(F.col("slice") < F.col("o"), 0).otherwise(1).cast("long").alias("side"), "fp",
        )
        tiles = tiles.unionByName(whole(fine)).unionByName(many)
    tiles = tiles.withColumn("tile", F.xxhash64(*by, "i", "j"))
    dealt = tiles.select("tile", "side", "fp").repartition("tile").sortWithinPartitions("tile", "fp")
    return dealt.mapInArrow(releasing(compare), "a long, b long")


def _classes(docs: DataFrame, row: str, shingle: int = SHINGLE) -> DataFrame:
    """row, doc_id, fp, component (its least fingerprint) and component_id of each row of docs, numbered in the column `row`."""
    rows = stored(fingerprints(docs, row, shingle), "simhash")
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "simhash-nodes")
    found = components(links(nodes.select("fp")))
    of_node = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("component"))
    named = of_node.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = stored(of_node.join(named, "component").select("fp", "n", "component", "component_id"), "simhash-classes")
    discard(nodes)
    return join_classes(rows, classes, "fp", "n", rows.count()).select("row", "doc_id", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp, component (its least fingerprint) and component_id of each row of docs."""
    return _classes(*numbered(docs.select("doc_id", "text")), shingle).drop("row")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least doc_id's (of repeated rows the first)."""
    rows, name = numbered(docs)
    kept = _classes(rows, name).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    return only_rows(rows, name, kept)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
