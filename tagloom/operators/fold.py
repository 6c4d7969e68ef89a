"""Greedy folding of tags into fewer categories.

One step folds a category c into its parents by their weights w: what the mapping gives to c is shared out by w, and every track's
mass on c moves along. Next is the unfolded non-root with the fewest tracks (W2 sizes), of ties the first by name. What a
fold leads to depends only on the set of folded tags, so a state is rebuilt from the order; only the order, the changes of the sizes and Gini are kept.

Tracks with equal votes behave alike, so they are compressed once to profiles with a count, and no state of the tracks is ever
written: a step derives the masses of the profiles it touches from their votes and the mapping, before and after, and the
sizes change by the difference. A profile is stored as the bytes of its entries, which a task reads as numpy arrays without a step for each row.
The profiles lie in one table, which a step reads once if its tags are frequent, and else in an inverted index, which is made when the first
step asks for it: one row for each tag of a profile, stored by groups of tags, the rows of a frequent tag dealt over several files. Of it a
step reads the groups of the touched tags only, and counts a profile at the first of its touched tags. The changes of the sizes
go to the driver, which holds what belongs to tags: edges and mapping.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions.stats import gini_of
from tagloom.operators import assign, dag, votes
from tagloom.sources.shared import discard, stored
from tagloom.sources.sizes import dealt, partitions_for

#: Groups of tags of the index, each a folder, and rows of a tag in one file.
GROUPS, FILE_ROWS = 512, 1_000_000
#: Cells (rows by categories) of a block whose masses are formed in one dense array; larger blocks are sorted.
MOST_CELLS = 4_000_000
#: A row of the index costs about as much as so many of the table: it is met once for each touched tag.
INDEX_COST = 8
#: An entry of a profile: the tag's place and the share.
ENTRY = np.dtype([("t", "<i4"), ("p", "<f8")])


@dataclass
class Folding:
    """tags (sorted), roots, order of the folds, changes of the sizes and ginis per state (state 0 first, with every size)."""

    tags: list[str]
    roots: list[str]
    weights: dict[str, dict[str, float]]  # child -> parent -> share
    order: list[str] = field(default_factory=list)
    changes: list[dict[str, int]] = field(default_factory=list)
    ginis: list[float] = field(default_factory=list)

    def sizes_at(self, step: int) -> dict[str, int]:
        """Every tag's size after so many folds, or after the last one."""
        out: dict[str, int] = {}
        for change in self.changes[: step + 1]:
            out |= change
        return out

    @property
    def sizes(self) -> list[dict[str, int]]:
        return [self.sizes_at(i) for i in range(len(self.changes))]

    def folded(self, k: int) -> list[str]:
        """The tags that are folded where k categories are left."""
        if not len(self.roots) <= k <= len(self.tags):
            raise ValueError(f"k must be from {len(self.roots)} to {len(self.tags)}")
        return self.order[: len(self.tags) - k]

    def spread(self, folded: list[str]) -> dict[str, dict[str, float]]:
        """Of each folded tag, the shares of the categories that are left: the paths over folded tags, parents first."""
        gone, done = {*folded}, {}
        for tag in folded:
            todo = [tag]
            while todo:
                x = todo[-1]
                wait = [] if x in done else [y for y in self.weights[x] if y in gone and y not in done]
                todo += wait
                if not wait:
                    todo.pop()
                if wait or x in done:
                    continue
                out: dict[str, float] = {}
                for parent, w in self.weights[x].items():
                    for cat, share in (done[parent] if parent in gone else {parent: 1.0}).items():
                        out[cat] = out.get(cat, 0.0) + w * share
                done[x] = out
        return done

    def mapping(self, folded: list[str]) -> list[tuple[str, str, float]]:
        """(tag, category, share)."""
        gone = self.spread(folded)
        return [(t, c, w) for t in self.tags for c, w in sorted(gone.get(t, {t: 1.0}).items())]

    def graph(self, folded: list[str]) -> list[tuple[str, str, float]]:
        """(child, parent, share) among the remaining categories after the folds."""
        gone, found = self.spread(folded), []
        for child in self.tags:
            out: dict[str, float] = {}
            for parent, w in self.weights.get(child, {}).items() if child not in gone else ():
                for cat, share in gone.get(parent, {parent: 1.0}).items():
                    out[cat] = out.get(cat, 0.0) + w * share
            found += [(child, parent, w) for parent, w in sorted(out.items())]
        return found


def start(p: DataFrame, graph: DataFrame) -> Folding:
    tags = sorted(r.tag for r in p.select("tag").distinct().collect())  # the vocabulary
    rows = dag.parent_weights(graph).select("child", "parent", "w").toArrow().to_pydict()  # pairs of tags at most
    weights: dict[str, dict[str, float]] = {}
    for child, parent, w in sorted(zip(rows["child"], rows["parent"], rows["w"], strict=True)):
        weights.setdefault(child, {})[parent] = w
    return Folding(tags, [t for t in tags if t not in weights], weights)


def _vectors(tags: list[str]):
    """For mapInArrow over rows of v (tag, p): the bytes of each row's entries of mass, by place in tags, and how often a batch has them."""

    def run(batches):
        places = pa.array(tags, pa.string())
        for batch in batches:
            v = batch.column(0)
            flat = v.flatten()
            t, p = pc.index_in(flat.field(0), places), flat.field(1).to_numpy(zero_copy_only=False)
            held = t.is_valid().to_numpy(zero_copy_only=False) & (p > 0)
            size = np.diff(np.concatenate(([0], np.cumsum(held)))[v.offsets.to_numpy() - v.offsets[0].as_py()])
            entries = np.empty(int(held.sum()), ENTRY)
            entries["t"], entries["p"] = t.fill_null(-1).to_numpy()[held], p[held]
            ends = (np.cumsum(size[size > 0]) * ENTRY.itemsize).astype(np.int32)
            offsets = pa.py_buffer(np.concatenate(([0], ends)).astype(np.int32).tobytes())
            counts = pa.Array.from_buffers(pa.binary(), len(ends), [None, offsets, pa.py_buffer(entries.tobytes())]).value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], names=["v", "n"])

    return run


def profiles(rows: DataFrame, tags: list[str], rare: dict[str, int]) -> DataFrame:
    """v, n: each different vote vector, as the bytes of its entries, and the number of its tracks; rows: votes.by_track()."""
    vectors = rows.select("v").mapInArrow(_vectors(tags), "v binary, n long")
    return dealt(vectors, partitions_for(sum(rare.values())), "v").groupBy("v").agg(F.sum("n").alias("n"))


def _by_tag(batches):
    """Of v and n, a row for each tag: t, ts (all tags of the profile), v, n."""
    for batch in batches:
        tag, _, row, n = _arrays(batch)
        size = np.bincount(row, minlength=batch.num_rows)
        ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        every = pa.array(row)
        ts = pa.ListArray.from_arrays(pa.array(ends), pa.array(tag))
        yield pa.RecordBatch.from_arrays([pa.array(tag), ts.take(every), batch.column(0).take(every), pa.array(n[row])], names=["t", "ts", "v", "n"])


def profile_index(p: DataFrame, tags: list[str], rare: dict[str, int], groups: int = GROUPS, rows: DataFrame | None = None) -> DataFrame:
    """grp, t, ts, v, n: for each tag (its place in tags) of each profile all its tags, its vote vector and the number of its tracks."""
    files = p.sparkSession.createDataFrame([(i, 1 + rare.get(t, 0) // FILE_ROWS) for i, t in enumerate(tags)], "t int, files int")
    each = profiles(votes.by_track(p) if rows is None else rows, tags, rare).mapInArrow(_by_tag, "t int, ts array<int>, v binary, n long")
    filed = each.join(F.broadcast(files), "t").withColumn("file", F.pmod(F.xxhash64("v"), F.col("files")))
    out = dealt(filed, partitions_for(sum(rare.values())), "t", "file")
    return stored(out.select((F.col("t") % groups).alias("grp"), "t", "ts", "v", "n"), "fold-index", by=("grp",))


def touched_rows(index: DataFrame, touched: list[int], groups: int = GROUPS) -> DataFrame:
    """Rows of the index for the touched tags; of other groups of tags nothing is read."""
    return index.where(F.col("grp").isin(sorted({t % groups for t in touched})) & F.col("t").isin(touched)).select("t", "ts", "v", "n")


def first_rows(index: DataFrame, touched: list[int], groups: int = GROUPS) -> DataFrame:
    """Of touched_rows, each profile once: at the first of its touched tags."""
    first = F.array_min(F.array_intersect("ts", F.array(*(F.lit(t).cast("int") for t in touched))))
    return touched_rows(index, touched, groups).where(F.col("t") == first)


def _arrays(batch) -> tuple[np.ndarray, ...]:
    """Tag, share and row of every entry of a block (v, n), and the rows' counts."""
    v = batch.column(0)
    ends = np.frombuffer(v.buffers()[1], np.int32, len(v) + 1, v.offset * 4)
    entries = np.frombuffer(v.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(ENTRY)
    size = np.diff(ends) // ENTRY.itemsize
    return np.ascontiguousarray(entries["t"]), np.ascontiguousarray(entries["p"]), np.repeat(np.arange(len(size)), size), batch.column(1).to_numpy()


class Mapping:
    """Categories and shares of every tag, as one long array of each."""

    def __init__(self, of: list[tuple[np.ndarray, np.ndarray]]):
        self.length = np.array([len(c) for c, _ in of], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.cats, self.shares = (np.concatenate([x[k] for x in of]) for k in (0, 1))

    def table(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The categories that get anything, those of least rank first, and every tag's share of each."""
        cats = np.unique(self.cats)
        cats = cats[np.argsort(rank[cats])]
        place = np.zeros(len(rank), np.int64)
        place[cats] = np.arange(len(cats))
        out = np.zeros((len(self.length), len(cats)))
        out[np.repeat(np.arange(len(self.length)), self.length), place[self.cats]] = self.shares
        return cats, out


def winners(tag: np.ndarray, p: np.ndarray, row: np.ndarray, mapping: Mapping, rank: np.ndarray) -> np.ndarray:
    """The category of most mass of each row (they ascend, none is empty), of ties the one of least rank."""
    if not len(row):
        return np.empty(0, np.int64)
    if max(int(row[-1]) + 1, len(rank)) * len(rank) <= MOST_CELLS:  # all categories of every row side by side, those of least rank first
        cats, share = mapping.table(rank)
        size = np.bincount(row)
        first = np.cumsum(size) - size
        mass = share[tag[first]] * p[first, None]
        for k in range(1, int(size.max())):  # the entries of a row one after the other
            more = np.flatnonzero(size > k)
            at = first[more] + k
            mass[more] += share[tag[at]] * p[at, None]
        mass *= 10.0**assign.DIGITS
        return cats[np.rint(mass, out=mass).argmax(1)]
    n = mapping.length[tag]
    entry = np.repeat(np.arange(len(tag)), n)
    at = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n) + mapping.start[tag][entry]
    key, inverse = np.unique(row[entry] * len(rank) + mapping.cats[at], return_inverse=True)
    mass = np.bincount(inverse, p[entry] * mapping.shares[at])
    row, cat = key // len(rank), key % len(rank)
    order = np.lexsort((rank[cat], -np.round(mass, assign.DIGITS), row))
    return cat[order][np.concatenate(([True], row[order][1:] != row[order][:-1]))]


def moved(block: tuple[np.ndarray, ...], touched: np.ndarray, before: Mapping | None, after: Mapping, rank: np.ndarray) -> np.ndarray:
    """How the sizes change over the rows of a block that hold a touched tag; before: None if nothing was counted yet."""
    tag, p, row, n = block
    held = np.zeros(len(n), bool)
    held[row[touched[tag]]] = True
    if not held.all():
        of = held[row]
        tag, p, row, n = tag[of], p[of], (np.cumsum(held) - 1)[row[of]], n[held]
    out = np.bincount(winners(tag, p, row, after, rank), n, len(rank))
    if before is not None:
        out -= np.bincount(winners(tag, p, row, before, rank), n, len(rank))
    return out.astype(np.int64)


def change(rows: DataFrame, touched: np.ndarray, before: Mapping | None, after: Mapping, rank: np.ndarray) -> np.ndarray:
    """How the sizes change over all profiles (v, n) that hold a touched tag; each of them is a row."""

    def run(batches):
        delta = np.zeros(len(rank), np.int64)
        for batch in batches:
            if batch.num_rows:
                delta += moved(_arrays(batch), touched, before, after, rank)
        cats = np.flatnonzero(delta)
        yield pa.RecordBatch.from_arrays([pa.array(cats, pa.int64()), pa.array(delta[cats], pa.int64())], names=["cat", "n"])

    out = np.zeros(len(rank), np.int64)
    for r in rows.select("v", "n").mapInArrow(run, "cat long, n long").groupBy("cat").agg(F.sum("n").alias("n")).collect():
        out[r.cat] = r.n
    return out


def _greedy(state: Folding, order: list[str] | None, rare: dict[str, int], step) -> Folding:
    """The loop; step(touched, before, after, rank) gives the change of the sizes over all profiles."""
    tags = state.tags
    at = {t: i for i, t in enumerate(tags)}
    rank = np.empty(len(tags), np.int64)
    rank[sorted(range(len(tags)), key=lambda i: (rare.get(tags[i], 0), tags[i]))] = np.arange(len(tags))
    of = [(np.array([i]), np.ones(1)) for i in range(len(tags))]
    holders = [{i} for i in range(len(tags))]  # of each category, the tags that give to it
    left = [t for t in tags if t in state.weights]
    given = None if order is None else [t for t in order if t in state.weights]
    unfolded, now = list(tags), Mapping(of) if tags else None
    sizes = step(np.ones(len(tags), bool), None, now, rank) if tags else np.empty(0, np.int64)
    state.changes.append({t: int(sizes[at[t]]) for t in tags})
    state.ginis.append(gini_of(sizes.tolist()))
    while left:
        tag = given[len(state.order)] if given else min(left, key=lambda t: (sizes[at[t]], t))
        c = at[tag]
        parts: dict[int, float] = {}
        for parent, w in state.weights[tag].items():
            for cat, share in zip(*of[at[parent]], strict=True):
                parts[int(cat)] = parts.get(int(cat), 0.0) + w * float(share)
        touched = np.zeros(len(tags), bool)
        for t in holders[c]:
            touched[t] = True
            shares = dict(zip(of[t][0].tolist(), of[t][1].tolist(), strict=True))
            mass = shares.pop(c)
            for cat, share in parts.items():
                shares[cat] = shares.get(cat, 0.0) + mass * share
                holders[cat].add(t)
            of[t] = np.array(sorted(shares)), np.array([shares[k] for k in sorted(shares)])
        before, now = now, Mapping(of)
        delta = step(touched, before, now, rank)
        sizes = sizes + delta
        left.remove(tag)
        unfolded.remove(tag)
        state.order.append(tag)
        state.changes.append({tags[i]: int(sizes[i]) for i in np.flatnonzero(delta).tolist()})
        state.ginis.append(gini_of([int(sizes[at[t]]) for t in unfolded]))
    return state


def fold(p: DataFrame, graph: DataFrame, order: list[str] | None = None, groups: int = GROUPS, rows: DataFrame | None = None) -> Folding:
    """The fold of votes p along a graph, in the order given or the smallest first. rows: votes.by_track(p), where it is at hand."""
    state = start(p, graph)
    if not state.tags:
        return _greedy(state, order, {}, None)
    rare = {r.tag: r.n for r in p.where("p > 0").groupBy("tag").agg(F.count("*").alias("n")).collect()}
    rows = votes.by_track(p) if rows is None else rows
    table = stored(profiles(rows, state.tags, rare), "fold-profiles")
    used, tracks = [table], table.agg(F.sum("n")).first()[0] or 0

    def step(touched, *states):
        some = np.flatnonzero(touched).tolist()
        if sum(rare.get(state.tags[t], 0) for t in some) * INDEX_COST >= tracks:
            return change(table, touched, *states)
        if len(used) == 1:
            used.append(profile_index(p, state.tags, rare, groups, rows))
        return change(first_rows(used[1], some, groups), touched, *states)

    try:
        return _greedy(state, order, rare, step)
    finally:
        discard(*used)


def tables(spark: SparkSession, state: Folding) -> dict[str, DataFrame]:
    """order(step, tag), sizes(step, tag, n), ginis(step, k, gini) of a folding."""
    g, last = len(state.tags), len(state.changes) - 1
    changes = spark.createDataFrame([(i, t, n) for i, s in enumerate(state.changes) for t, n in s.items()], "step int, tag string, n long")
    upto = F.coalesce(F.lead("step").over(W.partitionBy("tag").orderBy("step")) - 1, F.lit(last))  # a size holds until it changes
    return {
        "order": spark.createDataFrame([(i + 1, t) for i, t in enumerate(state.order)], "step int, tag string"),
        "sizes": changes.withColumn("upto", upto).select(F.explode(F.sequence("step", "upto")).alias("step"), "tag", "n"),
        "ginis": spark.createDataFrame([(i, g - i, x) for i, x in enumerate(state.ginis)], "step int, k int, gini double"),
    }


def mapping_table(spark: SparkSession, state: Folding, k: int) -> DataFrame:
    return spark.createDataFrame(state.mapping(state.folded(k)), "tag string, cat string, w double")


def graph_table(spark: SparkSession, state: Folding, k: int) -> DataFrame:
    """from_tag, to_tag, weight among the k categories."""
    return spark.createDataFrame(state.graph(state.folded(k)), "from_tag string, to_tag string, weight double")


def paths_mapping(parents: DataFrame, tags: DataFrame, folded: list[str]) -> DataFrame:
    """The mapping of a folded set by following parents until a category that isn't folded; for small graphs.

    As many joins as there are folded tags are enough, since no path visits one twice."""
    step = parents.where(F.col("child").isin(folded)).toDF("child", "parent", "share")
    now = tags.select("tag", F.col("tag").alias("cat"), F.lit(1.0).alias("w"))
    for _ in folded:
        on = now.join(step, F.col("cat") == F.col("child"), "left")
        moved_on = on.select("tag", F.coalesce("parent", "cat").alias("cat"), (F.col("w") * F.coalesce("share", F.lit(1.0))).alias("w"))
        now = moved_on.groupBy("tag", "cat").agg(F.sum("w").alias("w"))
    return now
