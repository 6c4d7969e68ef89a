"""Mixing sources to target weights: capped water-filling, then whole and fractional repetitions of documents.

The mix has as many words as all documents together. Sources share it by weight; none gets more than EPOCHS times its own words.

1. Documents are reduced to (doc_id, source, words, place in a seeded order), a narrow stored table: texts are read once, never shuffled.
2. Water-filling on the table of sources: those whose share lies above their cap are clamped to it, the excess goes to the others by weight,
   until none is above. A round is one aggregate over the sources; all of it is in whole numbers, so rounds and targets are exact.
3. A source's words are taken whole so many times as they fit its target; what is left is taken once more from the documents that come first in
   the seeded order, the last of them in part (its first words), so that the words taken are the target less its fraction.
   The prefix sums of that order have two levels: sums for each of SLOTS slots of a source's order, and rows only within
   the one slot in which the source's remainder ends. No source's documents meet in a task.

Sources are met by a join whose frequent keys are broadcast (fewer than a thousand) and whose other keys are shuffled.

Defined cases: a null or blank text has no words and takes none; a null source is a source of its own, after all others by code point; without any
words all targets are zero; repeated rows count each for itself (rows of one doc_id are ordered by their words); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions.ranks import placed
from tagloom.llm.common import documents, free_name, join_classes, numbered, stored, words_of

WEIGHTS, EPOCHS, SEED = (5, 2, 1), 3, 42
#: Slots of a source's seeded order: the first four hex digits.
SLOT_DIGITS = 4
WIDE = "decimal(38,0)"


def place(key: Column, seed: int = SEED) -> Column:
    """A document's place in the seeded order, as hex digits."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


def sizes(docs: DataFrame, seed: int = SEED, *others: str) -> DataFrame:
    """doc_id, source, size (words), h (place in the seeded order) and other columns of each row."""
    return docs.select(*others, "doc_id", "source", F.size(words_of(F.col("text"))).cast("long").alias("size"), place(F.col("doc_id"), seed).alias("h"))


def key_of(source: Column) -> Column:
    """A text for every source, the null one too."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def weighed(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """sources(source, ...) with w: the weights in turn, by code point, null last."""
    ranked = placed(sources, [F.col("source").asc_nulls_last()])
    chosen = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    return ranked.withColumn("w", chosen.cast("long")).drop("place")


def filled(sources: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """sources(size, w, ...) with target (double) and words (its whole part), by capped water-filling of all words.

    A round clamps what lies above epochs times its size at the present level, rest / weight. The level only grows, so what was above
    stays above, and the rounds end when no further source is."""
    if epochs < 1:
        raise ValueError("fewer epochs than one can't hold as many words as there are")
    cap, none = F.col("size").cast(WIDE) * epochs, F.lit(0)
    total, weight = (int(x) for x in sources.agg(F.coalesce(F.sum(F.col("size").cast(WIDE)), none), F.coalesce(F.sum("w"), none)).first())
    rest, left, clamped = total, weight, 0
    while True:
        over = F.col("w").cast(WIDE) * F.lit(rest).cast(WIDE) > cap * F.lit(left).cast(WIDE)
        n, used, gone = (int(x) for x in sources.where(over).agg(F.count("*"), F.coalesce(F.sum(cap), none), F.coalesce(F.sum("w"), none)).first())
        if n == clamped:
            break
        clamped, rest, left = n, total - used, weight - gone
    share, level = F.col("w") * F.lit(rest).cast("long"), F.lit(max(left, 1)).cast("long")
    return sources.withColumns({
        "target": F.when(over, cap.cast("double")).otherwise(share.cast("double") / level),
        "words": F.when(over, cap.cast("long")).otherwise((share - F.pmod(share, level)) / level).cast("long"),
    })


def taken(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """sized, a stored table of sizes(), with source_size, target, repeats (whole repetitions), part (words of one more) and taken."""
    others = [c for c in sized.columns if c != "h"]
    rows = sized.withColumns({"key": key_of(F.col("source")), "slot": F.conv(F.substring("h", 1, SLOT_DIGITS), 16, 10).cast("int")})
    sums = rows.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("size"), F.count("*").alias("n"))
    share = filled(stored(weighed(sums, weights), "mix-weights"), epochs)
    some = F.col("size") > 0
    sources = share.select(
        "key", "n", F.col("size").alias("source_size"), "target",
        F.when(some, F.expr("words div size")).otherwise(F.lit(0)).cast("long").alias("repeats"),
        F.when(some, F.expr("words % size")).otherwise(F.lit(0)).cast("long").alias("rest"),
    )
    slots = rows.groupBy("key", "slot").agg(F.sum("size").alias("here"))
    upto = slots.withColumn("upto", F.sum("here").over(W.partitionBy("key").orderBy("slot")))  # at most 65,536 rows a source
    ends = upto.join(sources.select("key", "rest"), "key").where("upto - here <= rest and rest < upto").select("key", F.col("slot").alias("last"), (F.col("rest") - F.col("upto") + F.col("here")).alias("within"))
    classes = stored(sources.drop("rest").join(ends, "key", "left").fillna(-1, ["last"]), "mix-classes")
    met = join_classes(rows, classes, "key", "n", rows.count())
    clear = met.where("slot <> last").withColumn("part", F.when(F.col("slot") < F.col("last"), F.col("size")).otherwise(F.lit(0).cast("long")))
    before = F.sum("size").over(W.partitionBy("key").orderBy("h", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1))  # one slot of a source
    cut = met.where("slot = last").withColumn("part", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("within") - F.coalesce(before, F.lit(0)))))
    out = clear.unionByName(cut)
    return out.select(*others, "source_size", "target", "repeats", "part", (F.col("size") * F.col("repeats") + F.col("part")).alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """The mix itself: docs' rows, each as many times as it is taken, with `copy` (from 1); the last copy may hold the first words only, joined by spaces."""
    rows, row = numbered(docs)
    copy = free_name(docs, "copy")
    plan = taken(stored(sizes(rows.select("doc_id", "source", "text", F.col(row).alias("at")), seed, "at"), "mix-sizes"), weights, epochs)
    plan = plan.where("taken > 0").select(F.col("at").alias(row), F.struct("repeats", "part", "size").alias("__take"))
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__take.repeats") + F.when(F.col("__take.part") > 0, 1).otherwise(0)))
    whole = (F.col(copy) <= F.col("__take.repeats")) | (F.col("__take.part") == F.col("__take.size"))
    some = F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col("__take.part").cast("int")), " ")
    text = F.when(whole, F.col("text")).otherwise(some)
    out = rows.join(plan, row).withColumn(copy, copies).withColumn("text", text)
    return out.select(*docs.columns, copy)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = stored(sizes(documents(spark, sf_dir)), "mix-sizes")
    return taken(sized).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = f"""WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
l AS (SELECT *, size * 10 // w AS fullness, sum(size) OVER () - {EPOCHS} * coalesce(sum(size) OVER p, 0) AS rest, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS left_w FROM s
 WINDOW p AS (ORDER BY size * 10 // w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
k AS (SELECT rest, left_w FROM l WHERE w * rest <= {EPOCHS} * size * left_w ORDER BY fullness, source LIMIT 1),
t AS (SELECT source, size AS source_size, CASE WHEN w * rest > {EPOCHS} * size * left_w THEN CAST({EPOCHS} * size AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / left_w END AS target,
 CASE WHEN w * rest > {EPOCHS} * size * left_w THEN {EPOCHS} * size ELSE w * rest // left_w END AS words FROM s, (SELECT * FROM k) z),
x AS (SELECT d.*, source_size, target, words // greatest(source_size, 1) AS repeats, words % greatest(source_size, 1) AS rest,
 coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * repeats + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM x"""
