"""SimHash near-duplicates in the wide: texts whose word shingles have a Jaccard similarity of 0.8 or more.

The bit-sliced comparison of `simhash`, with a radius for this similarity and an exact check of what lies within it; the pipeline's stage.
Texts at a similarity of 0.8 differ in about 10 of 64 bits, with a spread of 3. A radius that finds them has no selective
keys of its own, so the blocks in which fingerprints are compared come from banded minimum hashes.

1. Each text gives the set of its shingles' XXH64 and BANDS keys of ROWS minimum hashes. Equal sets become one node.
2. Nodes that share a key are candidates; of each key's nodes the least is linked to the others, and components of these links
   are the blocks. At the least similarity a pair shares no key with a chance of (1 - 0.8**4)**24 = 3e-6, and less above it.
3. The sets of a block meet in a task. The fingerprints of the sets (each shingle once) are compared bit-sliced, many blocks
   at a time; pairs within RADIUS (five spreads beyond the expected 10 bits) that aren't in one tree yet are compared in full.
   A large block is cut into slices, and each pair of slices is a task of its own.
4. Components of the links that pass are the near-duplicates.

Defined cases: null and blank texts have the empty set and are alike; fewer words than a shingle form one shingle; the rest as
in simhash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.llm import simhash
from tagloom.llm.common import discard, join_classes, numbered, only_rows, parted, releasing, stored
from tagloom.llm.components import components
from tagloom.llm.simhash import SEED

SHINGLE = 5
#: Least similarity of a link, in percent.
PERCENT = 80
BANDS, ROWS = 24, 4
#: Bits within which two fingerprints are compared in full.
RADIUS = 24
#: Sets of one component that one task compares, and their bytes.
TILE, TILE_BYTES = 4096, 64 << 20
#: Shingles whose minimum hashes are formed at once.
CHUNK = 512
_pick = np.random.default_rng(SEED)
FACTORS = _pick.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _pick.integers(0, 1 << 63, BANDS * ROWS, np.uint64)


def shingle_set(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(simhash.shingle_hashes(text, shingle))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, "<u8")
    for lo in range(0, len(hashes), CHUNK):
        least = np.minimum(least, (hashes[lo : lo + CHUNK, None] * FACTORS + TERMS).min(0))
    data = least.tobytes()
    return np.array([xxhash.xxh64_intdigest(data[8 * ROWS * k : 8 * ROWS * (k + 1)], k) for k in range(BANDS)], "<u8").view("<i8")


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets' similarity is PERCENT or more."""
    small, large = sorted((len(a), len(b)))
    if 100 * small < PERCENT * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= PERCENT * (small + large - both)


def described(docs: DataFrame, row: str) -> DataFrame:
    """row, doc_id, node (hash of the set), size (of the set) and keys of each row of docs, numbered in the column `row`."""

    def run(batches):
        for batch in batches:
            node, size, keys = [], [], []
            for t in batch.column(2):
                s = shingle_set(t.as_py())
                node.append(np.uint64(xxhash.xxh64_intdigest(s.tobytes(), SEED)).view(np.int64))
                size.append(len(s))
                keys.append(band_keys(s))
            flat = np.concatenate(keys) if keys else np.empty(0, "<i8")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(node, pa.int64()), pa.array(size, pa.int64()), lists], names=["row", "doc_id", "node", "size", "keys"])

    return docs.select(F.col(row).alias("row"), "doc_id", "text").mapInArrow(releasing(run), "row long, doc_id long, node long, size long, keys array<long>")


def candidates(rows: DataFrame) -> DataFrame:
    """a, b: for every key that nodes of rows(node, keys) share, its least node and each other one."""
    keyed = rows.select("node", F.explode("keys").alias("key"))
    bounds = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n"))
    shared = stored(bounds.where("least <> most").drop("most"), "similar-keys")
    met = join_classes(keyed, shared, "key", "n", BANDS * rows.count())
    return met.where("least <> node").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct()


def compare(batches):
    """For mapInArrow: rows (tile, side, node, text), each tile's together -> links (a, b). Holds TILE sets or TILE_BYTES of them, and one tile."""

    def out():
        prints = np.array([simhash.majority(s) for s in sets], np.uint64)
        of = np.array(nodes, np.int64)
        a, b = simhash.links_of(np.array(tiles, np.int64), np.array(sides, np.int64), prints, RADIUS, lambda i, j: alike(sets[i], sets[j]))
        return pa.RecordBatch.from_arrays([pa.array(of[a]), pa.array(of[b])], names=["a", "b"])

    tiles, sides, nodes, sets, held = [], [], [], [], 0
    for batch in batches:
        for tile, side, node, text in zip(*(batch.column(k) for k in range(4)), strict=True):
            if tiles and tile.as_py() != tiles[-1] and (len(sets) >= TILE or held >= TILE_BYTES):
                yield out()
                tiles, sides, nodes, sets, held = [], [], [], [], 0
            tiles.append(tile.as_py())
            sides.append(side.as_py())
            nodes.append(node.as_py())
            sets.append(shingle_set(text.as_py()))
            held += sets[-1].nbytes
    if tiles:
        yield out()


def links(docs: DataFrame, row: str, rows: DataFrame, nodes: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """a, b: nodes(node, row, size) of docs, described by rows, whose components are those of all pairs that are alike."""
    member = stored(components(candidates(rows)).join(nodes.select("node", "row", "size"), "node"), "similar-members")
    size = member.groupBy("root").agg(F.greatest(F.ceil(F.count("*") / (tile // 2)), F.ceil(8 * F.sum("size") / (tile_bytes // 2))).alias("slices"), F.count("*").alias("n"), F.sum("size").alias("all"))
    whole = (F.col("n") <= tile) & (8 * F.col("all") <= tile_bytes)
    n = member.count()
    dealt = join_classes(member, size, "root", "n", n).withColumn("slices", F.when(whole, 1).otherwise(F.col("slices")))
    # slice i of a large component meets each slice j: rows of a slice go to as many tiles as there are slices
    cut = dealt.withColumn("slice", F.pmod(F.xxhash64("node"), F.col("slices"))).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    tiles = cut.select(
        "row", "node", F.xxhash64("root", F.least("slice", "o"), F.greatest("slice", "o")).alias("tile"),
        F.when(F.col("slice") == F.col("o"), -1).when(F.col("slice") < F.col("o"), 0).otherwise(1).alias("side"),
    )
    few, _ = parted(docs.select(F.col(row).alias("row"), "text"), "row", member.select("row"), n)
    met = few.join(tiles, "row").select("tile", "side", "node", "text")
    return met.repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(releasing(compare), "a long, b long")


def _classes(docs: DataFrame, row: str, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """row, doc_id and component (its least node) of each row of docs, numbered in the column `row`."""
    rows = stored(described(docs, row), "similar")
    nodes = stored(rows.groupBy("node").agg(F.min("row").alias("row"), F.min("size").alias("size"), F.count("*").alias("n")), "similar-nodes")
    found = components(links(docs, row, rows, nodes, tile, tile_bytes)).withColumnRenamed("node", "of")
    classes = stored(nodes.join(found, F.col("node") == F.col("of"), "left").select("node", "n", F.coalesce("root", "node").alias("component")), "similar-classes")
    discard(nodes)
    return join_classes(rows.select("row", "doc_id", "node"), classes, "node", "n", rows.count()).select("row", "doc_id", "component")


def near_duplicates(docs: DataFrame, tile: int = TILE, tile_bytes: int = TILE_BYTES) -> DataFrame:
    """doc_id and component of each row of docs."""
    return _classes(*numbered(docs.select("doc_id", "text")), tile, tile_bytes).drop("row")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: the least doc_id's (of repeated rows the first)."""
    rows, name = numbered(docs)
    kept = _classes(rows, name).groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))["row"].alias("row"))
    return only_rows(rows, name, kept)
