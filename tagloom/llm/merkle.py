"""A Merkle manifest of a table: a leaf for each row, a tree of runs of eight for each group, one tree over the groups, proofs.

A leaf is the hash of the row's fields, each written as `-` if null, else its UTF-8 byte count, `:` and its value. A group's leaves
ascend by key; while several nodes remain, every FAN consecutive ones become the hash of their joined hex digests.
What remains is the group's subroot, and the subroots, in order of group, give the root by the same rule.

1. Leaves are hashed by Spark (texts are read once and never shuffled) and range-sorted by (group, key, leaf) into an RDD, so a hot group is
   many partitions. Equal rows are told apart by a running number: they are dealt out too.
2. One record a partition (its first and last group, with counts) goes to the driver, which gives each partition the places of
   its leaves: how many leaves of its first group, and how many groups, come before it, and the sizes of its first and last group.
3. Each partition hashes the subtrees that are complete within it. The nodes that are left over, at most seven a level at either
   end of a partition's part of a group, are shuffled by the coordinate (group's number, level, place) of their parent,
   level by level; so are the subroots, in the upper tree.
4. Each parent formed by a shuffle is sent to the partitions whose leaves lie below it (a range of numbers). There the siblings of every leaf are at hand:
   the partition returns digests, proofs and the root that each proof folds to. Partitions and what they are sent are zipped, so leaves move once.

Defined cases: a null group is a group of its own, the first; a null key comes first; rows of one key are ordered by their leaves; a group of one leaf has that leaf as
its subroot, and a table of one group its subroot as the root, both with fewer siblings; an empty table gives no rows; a text is only held as
Spark's string. Nothing but one record a partition reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm.common import documents

FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of leaves (about 200 bytes each) that one partition is meant to hold.
LEAVES_PER_TASK = 200_000
#: The number of the tree over the groups.
UPPER = -1
SCHEMA = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def field(c: Column) -> Column:
    value = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in FIELDS)), 256)


def tampered_rows(key: Column) -> Column:
    """Which rows the check tampers with: those for which 3 divides the crc32 of the key in decimals."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 0, F.lit(False))


def digest(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels_of(n: int) -> list[int]:
    """Nodes on each level of a tree of n leaves, the last one 1."""
    sizes = [n]
    while sizes[-1] > 1:
        sizes.append(-(-sizes[-1] // FAN))
    return sizes


@dataclass(frozen=True)
class Place:
    """Of a partition: the number of its first group, the leaves of that group before it, and the sizes of its first and last group."""

    group: int
    before: int
    first_size: int
    last_size: int


def places(found: list[tuple[int, object, int, object, int, int]], parts: int) -> tuple[list[Place | None], int, int]:
    """The place of each partition, the number of groups, and the largest group, from one record for each partition with rows:
    (partition, first group, its rows here, last group, its rows here, groups here)."""
    rows = sorted(found, key=lambda r: r[0])
    sizes: list[list[int]] = []  # of a group that runs on, one cell that all its partitions share
    at: list[Place | None] = [None] * parts
    groups, before, cells, last = -1, 0, [], None
    for k, first, n_first, end, n_end, here in rows:
        runs_on = last is not None and last[0] == first
        if not runs_on:
            groups, before, cell = groups + 1, 0, [0]
        start = (groups, before)
        cell[0] += n_first
        first_cell = cell
        if here > 1:
            groups, before, cell = groups + here - 1, 0, [0]
            cell[0] += n_end
            before = n_end
        else:
            before += n_first
        last = (end,)
        cells.append((k, start, first_cell, cell))
        sizes += [first_cell, cell]
    for k, (group, n), first_cell, last_cell in cells:
        at[k] = Place(group, n, first_cell[0], last_cell[0])
    most = max((c[0] for c in sizes), default=0)
    return at, groups + 1, most


def ends(k: int, rows: Iterator) -> Iterator[tuple]:
    """A partition's record for places(), and the size of its largest whole group among its rows."""
    first = last = None
    n_first = n_last = n = most = 0
    for r in rows:
        if last is None or r.grp != last[0]:
            n += 1
            last, n_last = (r.grp,), 0
            first = first or last
        n_last += 1
        n_first += n == 1
        most = max(most, n_last)
    if n:
        yield (k, first[0], n_first, last[0], n_last, n), most


@dataclass
class Segment:
    """A partition's part of a group: its number, its size, the place of the first leaf here, and the complete nodes of every level
    with the place of the first."""

    group: int
    size: int
    first: int
    levels: list[tuple[int, list[str]]]

    def complete(self, level: int, at: int) -> bool:
        if level >= len(self.levels):
            return False
        lo, nodes = self.levels[level]
        return lo <= at < lo + len(nodes)


def grown(group: int, size: int, first: int, leaves: list[str]) -> Segment:
    """Hashes what is complete: the nodes all of whose leaves are here."""
    levels = [(first, leaves)]
    for below in levels_of(size)[:-1]:
        lo, nodes = levels[-1]
        start, end = -(-lo // FAN), (lo + len(nodes)) // FAN
        if lo + len(nodes) == below:  # the last run may be short
            end = -(-below // FAN)
        if start >= end:
            break
        levels.append((start, [digest(nodes[FAN * k - lo : FAN * k - lo + FAN]) for k in range(start, end)]))
    return Segment(group, size, first, levels)


def segments(rows: list, place: Place) -> Iterator[tuple[Segment, list]]:
    """The segments of a partition's rows (grp, doc_id, leaf, changed), with their rows."""
    cut = [0, *(k for k in range(1, len(rows)) if rows[k].grp != rows[k - 1].grp), len(rows)]
    for k, (lo, hi) in enumerate(zip(cut, cut[1:], strict=False)):
        part = rows[lo:hi]
        size = place.first_size if k == 0 else place.last_size if hi == len(rows) else hi - lo
        yield grown(place.group + k, size, place.before if k == 0 else 0, [r.leaf for r in part]), part


# A node on its way: ((tree, level, place of the parent), (place among its siblings, digest, first partition, last partition, leaves of the tree))


def loose(k: int, rows: Iterator, place: Place | None) -> Iterator[tuple]:
    """The nodes of a partition whose parent isn't complete here: level by level, those at either end; and whole groups' subroots,
    as leaves of the upper tree."""
    if place is None:
        return
    for s, _ in segments(list(rows), place):
        sizes = levels_of(s.size)
        for level, (lo, nodes) in enumerate(s.levels):
            if sizes[level] == 1:
                yield (UPPER, 0, s.group), (0, nodes[0], k, k, 0)
                continue
            for i, node in enumerate(nodes):
                parent = (lo + i) // FAN
                if not s.complete(level + 1, parent):
                    yield (s.group, level + 1, parent), ((lo + i) % FAN, node, k, k, s.size)


def joined(pair: tuple) -> tuple:
    """A parent of shuffled children: its key, children in order, partitions and tree size."""
    key, found = pair
    children = sorted(found)
    return key, [c[1] for c in children], min(c[2] for c in children), max(c[3] for c in children), children[0][4]


def climbed(parent: tuple) -> Iterator[tuple]:
    """The parent as a node on its way up."""
    (tree, level, at), children, lo, hi, size = parent
    node, top = digest(children), len(levels_of(size)) - 1
    if level < top:
        yield (tree, level + 1, at // FAN), (at % FAN, node, lo, hi, size)
    elif tree != UPPER:
        yield (UPPER, 0, tree), (0, node, lo, hi, 0)


def finished(nodes: RDD, groups: int, largest: int, parts: int) -> RDD:
    """All parents that take a shuffle: the groups' trees level by level, then the tree over the groups."""
    here = lambda tree_level: lambda n: (n[0][0] == UPPER, n[0][1]) == tree_level
    parents, climbing, subroots = [], None, [nodes.filter(here((True, 0)))]
    for level in range(1, len(levels_of(largest))):
        rows = nodes.filter(here((False, level)))
        up = (rows if climbing is None else rows.union(climbing.filter(here((False, level))))).groupByKey(parts).map(joined)
        climbing = up.flatMap(climbed)
        parents.append(up)
        subroots.append(climbing.filter(here((True, 0))))
    now = nodes.context.union(subroots).map(lambda n: ((UPPER, 1, n[0][2] // FAN), (n[0][2] % FAN, *n[1][1:4], groups)))
    for _ in range(1, len(levels_of(groups))):
        up = now.groupByKey(parts).map(joined)
        parents.append(up)
        now = up.flatMap(climbed)
    return nodes.context.union(parents) if parents else nodes.context.emptyRDD()


class Paths:
    """The siblings above a place in a tree, kept while neighbouring places share them."""

    def __init__(self, tree: int, size: int, known):
        self.tree, self.sizes, self.known = tree, levels_of(size), known
        self.at: list[int] = [-1] * (len(self.sizes) - 1)
        self.runs: list[tuple[str, str]] = [("", "")] * (len(self.sizes) - 1)
        self.top = ""

    def to(self, place: int) -> None:
        """Moves to a leaf."""
        for level in range(len(self.at)):
            if self.at[level] == place:
                return
            children = self.known(self.tree, level, place // FAN)
            self.at[level] = place
            self.runs[level] = "".join(children[: place % FAN]), "".join(children[place % FAN + 1 :])
            place //= FAN
            if level == len(self.at) - 1:
                self.top = digest(children)

    def proof(self) -> str:
        return "".join(a + b for a, b in self.runs)

    def fold(self, node: str) -> str:
        for a, b in self.runs:
            node = digest([a, node, b])
        return node


def proved(rows: list, place: Place | None, groups: int, sent: dict) -> Iterator[tuple]:
    """A partition's result: of each row the digests, the proof and what it folds to."""
    if place is None:
        return
    upper = None
    for s, part in segments(rows, place):

        def known(tree: int, level: int, parent: int, s: Segment = s) -> list[str]:
            if tree != UPPER and s.complete(level + 1, parent):
                lo, nodes = s.levels[level]
                return nodes[FAN * parent - lo : FAN * parent - lo + FAN]
            return sent[tree, level + 1, parent]

        own = Paths(s.group, s.size, known)
        upper = upper or Paths(UPPER, groups, known)
        upper.to(s.group)
        above = upper.proof()
        for i, r in enumerate(part):
            own.to(s.first + i)
            subroot = own.top or r.leaf
            root = upper.top or subroot
            folded = upper.fold(own.fold(r.changed or r.leaf))
            yield r.key, r.leaf, subroot, root, hashlib.sha256((own.proof() + above).encode()).hexdigest(), folded, folded == root


def manifest(docs: DataFrame, tampered=tampered_rows, leaves_per_task: int = LEAVES_PER_TASK) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of each row of docs (FIELDS, grouped by lang).

    tampered: from the key's column to a condition; where it holds, folded_root starts from the leaf of the row with A-Z of its text lower-cased."""
    spark = docs.sparkSession
    own = {c: F.col(c) for c in FIELDS}
    other = own | {"text": F.translate("text", CAPITALS, CAPITALS.lower())}
    hashed = docs.select(
        F.col("lang").cast("string").alias("grp"), F.col("doc_id").cast("long").alias("key"), leaf(own).alias("leaf"),
        F.when(tampered(F.col("doc_id")), leaf(other)).alias("changed"), F.monotonically_increasing_id().alias("same"),
    )
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // leaves_per_task))
    order = ("grp", "key", "leaf", "same")
    # of equal rows any order gives the same digests; the last key only deals them out
    rows = hashed.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("same").rdd
    parts = rows.getNumPartitions()
    found = rows.mapPartitionsWithIndex(ends).collect()  # one record a partition
    at, groups, largest = places([r for r, _ in found], parts)
    if not groups:
        return spark.createDataFrame([], SCHEMA)
    largest = max(largest, *(most for _, most in found))
    nodes = rows.mapPartitionsWithIndex(lambda k, it: loose(k, it, at[k]))
    tasks = max(1, min(parts, parts * FAN * len(levels_of(largest)) // 10_000 + 1))
    sent = finished(nodes, groups, largest, tasks).flatMap(lambda p: ((k, (p[0], p[1])) for k in range(p[2], p[3] + 1)))
    by_part = sent.partitionBy(parts, lambda k: k).mapPartitions(lambda it: [{key: children for _, (key, children) in it}])
    whole = rows.mapPartitions(lambda it: [list(it)])
    out = whole.zip(by_part).mapPartitionsWithIndex(lambda k, it: (x for mine, known in it for x in proved(mine, at[k], groups, known)))
    return spark.createDataFrame(out, SCHEMA, verifySchema=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


#: Levels that the SQL below climbs: trees of up to 8**DEPTH leaves.
DEPTH = 9


def _sql_tree(name: str, nodes: str, by: str) -> str:
    """CTEs name0 .. name{DEPTH}: the nodes of each level of the trees of nodes(by, i, d)."""
    parts = [f"{name}0 AS MATERIALIZED (SELECT {by}, i, d, count(*) OVER (PARTITION BY {by}) AS n FROM {nodes})"]
    for k in range(DEPTH):
        up = f"SELECT {by}, i // {FAN} AS i, sha256(string_agg(d, '' ORDER BY i)) AS d FROM {name}{k} WHERE n > 1 GROUP BY {by}, i // {FAN} UNION ALL SELECT {by}, i, d FROM {name}{k} WHERE n = 1"
        parts.append(f"{name}{k + 1} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {by}) AS n FROM ({up}) z)")
    return ",\n".join(parts)


def _sql_climb(name: str, tree: str, start: str) -> str:
    """CTEs name0 .. name{DEPTH}: rows of start(r, g, i, now, proof) a level higher each: what they fold to, and their siblings so far."""
    parts = [f"{name}0 AS (SELECT * FROM {start})"]
    for k in range(DEPTH):
        run = f"SELECT g, i // {FAN} AS j, list(d ORDER BY i) AS run FROM {tree}{k} WHERE n > 1 GROUP BY 1, 2"
        left, right = f"array_to_string(run[1:c.i % {FAN}], '')", f"array_to_string(run[c.i % {FAN} + 2:], '')"
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT c.r, c.g, c.i // {FAN} AS i, CASE WHEN run IS NULL THEN now ELSE sha256({left} || now || {right}) END AS now,
 CASE WHEN run IS NULL THEN proof ELSE proof || {left} || {right} END AS proof FROM {name}{k} c LEFT JOIN ({run}) x ON x.g = c.g AND x.j = c.i // {FAN})""")
    return ",\n".join(parts)


def _sql_leaf(text: str) -> str:
    one = lambda c: f"coalesce(CAST(octet_length(encode(CAST({c} AS VARCHAR))) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    return f"sha256({' || '.join(one(text if c == 'text' else c) for c in FIELDS)})"


CRC_SQL = f"""crc AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor({0xEDB88320}, c >> 1) ELSE c >> 1 END) ORDER BY i) AS step FROM (SELECT CAST(range AS BIGINT) AS i FROM range(256)) z)"""


def crc_sql(text: str) -> str:
    """crc32 of a text's UTF-8 bytes, with the CTE crc at hand."""
    codes = f"list_transform(range(1, 2 * octet_length(encode({text})), 2), lambda k: CAST('0x' || substr(hex(encode({text})), k, 2) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])))"


ORACLE = f"""WITH {CRC_SQL},
a AS (SELECT doc_id, lang, {_sql_leaf("text")} AS leaf, CASE WHEN {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0 THEN {_sql_leaf(f"translate(text, '{CAPITALS}', '{CAPITALS.lower()}')")} END AS changed FROM documents, crc),
b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, row_number() OVER () AS r FROM a),
l AS (SELECT g, i, leaf AS d FROM b),
{_sql_tree("t", "l", "g")},
u AS (SELECT 0 AS g, g AS i, d FROM t{DEPTH}),
{_sql_tree("v", "u", "g")},
s AS (SELECT r, g, i, coalesce(changed, leaf) AS now, '' AS proof FROM b),
{_sql_climb("c", "t", "s")},
w AS (SELECT r, 0 AS g, g AS i, now, proof FROM c{DEPTH}),
{_sql_climb("e", "v", "w")}
SELECT doc_id, leaf, u.d AS subroot, v{DEPTH}.d AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = v{DEPTH}.d AS verified
FROM b JOIN e{DEPTH} USING (r) JOIN u ON u.i = b.g, v{DEPTH}"""
