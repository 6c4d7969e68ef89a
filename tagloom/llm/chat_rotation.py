"""Chat formatting: multi-party dialogues, rendered once from the perspective of each participant.

In a rotation the chosen speaker is the assistant, every other speaker is a named user, and system turns stay system
turns. A row is one turn of one rotation: the rendered segment, its character offset in the rotation's whole text, and
the span that the loss mask selects (the assistant's text and its end mark). Concatenating the segments by position gives
the dialogue; no dialogue is ever gathered in one row, so a conversation may hold any share of the table.

Offsets are prefix sums in two levels: rows are range-partitioned by rotation and order, down to the row's number, so that neither a
long conversation nor many equal turns meet in one task; sums within each part of a rotation are added to the sums of its
parts before. They need lengths only, so the texts move once, when they meet their places.

Text can't forge a turn: where it holds `<|`, or `<` and backslashes before `|`, a backslash is put before the `|` (taking one
away there gives the text back). In names, backslashes and line breaks are written as escapes as well.

Defined cases: a null role speaks as "unknown"; null text is empty; null turns come first; equal turns are ordered by role
and the text's MD5; repeated rows are repeated turns; a conversation of system turns only has one rotation without assistant
turns, whose perspective is null; null conv_ids form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.llm.common import numbered, stored

SYSTEM = "system"
START, END = "<|im_start|>", "<|im_end|>\n"


def escaped(text: Column) -> Column:
    """text in which no mark can be read."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def escaped_name(name: Column) -> Column:
    """A speaker's name on one line, without marks; different names stay different."""
    for plain, code in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
        name = F.replace(name, F.lit(plain), F.lit(code))
    return escaped(name)


def rotations(turns: DataFrame) -> DataFrame:
    """conv_id, perspective, turn, position, role, segment, start, mask_start, mask_length (0: nothing learned)."""
    plain, row = numbered(turns.select("conv_id", "turn", "role", "text"))
    text = F.coalesce("text", F.lit(""))
    clean = plain.select(F.col(row).alias("row"), "conv_id", "turn", F.coalesce("role", F.lit("unknown")).alias("speaker"), F.char_length(escaped(text)).alias("chars"), F.md5(text).alias("tie"))
    # one row per conversation and participant; conversations without any keep one row with a null perspective
    spoken = clean.where(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("v_conv"), F.col("speaker").alias("perspective")).distinct()
    silent = clean.groupBy("conv_id").agg(F.bool_and(F.col("speaker") == SYSTEM).alias("silent")).where("silent")
    views = spoken.unionByName(silent.select(F.col("conv_id").alias("v_conv"), F.lit(None).cast("string").alias("perspective")))

    own = F.col("speaker").eqNullSafe(F.col("perspective"))
    named = F.concat(F.lit(f"{START}user name="), escaped_name(F.col("speaker")), F.lit("\n"))
    header = F.when(F.col("speaker") == SYSTEM, F.lit(f"{START}system\n")).when(own, F.lit(f"{START}assistant\n")).otherwise(named)
    rows = clean.join(views, F.col("conv_id").eqNullSafe(F.col("v_conv"))).withColumns({"header": header, "own": own})
    rows = rows.withColumn("length", (F.char_length("header") + F.col("chars") + len(END)).cast("long")).drop("v_conv")
    group, order = ["conv_id", "perspective"], ["turn", "speaker", "tie", "row"]
    dealt = stored(rows.repartitionByRange(*group, *order).withColumn("part", F.spark_partition_id()), "chat-rows")
    sums = dealt.groupBy("part", *group).agg(F.sum("length").alias("total"), F.count("*").alias("n"))
    before = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # at most one row a part
    base = sums.select(
        *(F.col(c).alias(f"b_{c}") for c in ["part", *group]),
        F.coalesce(F.sum("total").over(before), F.lit(0)).alias("chars_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
    )
    same = F.col("part") == F.col("b_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"b_{c}"))
    within = W.partitionBy("part", *group).orderBy(*order)
    start = F.col("chars_before") + F.coalesce(F.sum("length").over(within.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = dealt.join(base, same).select("*", start.alias("start"), (F.col("n_before") + F.row_number().over(within)).alias("position"))
    texts = plain.select(F.col(row).alias("t_row"), escaped(text).alias("text"))
    learned = F.col("chars") + len(END) - 1
    return placed.join(texts, F.col("row") == F.col("t_row")).select(
        "conv_id", "perspective", "turn", "position", F.col("speaker").alias("role"), F.concat("header", "text", F.lit(END)).alias("segment"), "start",
        (F.col("start") + F.char_length("header")).alias("mask_start"),
        F.when(F.col("own"), learned).otherwise(0).cast("long").alias("mask_length"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS raw,
             regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\\\1|', 'g') AS text FROM conversations),
n AS (SELECT *, regexp_replace(replace(replace(replace(speaker, '\', '\\'), chr(10), '\n'), chr(13), '\r'), '<(\\*)\|', '<\\\1|', 'g') AS name FROM c),
v AS (SELECT DISTINCT conv_id, speaker AS perspective FROM c WHERE speaker <> '{SYSTEM}'
      UNION ALL SELECT conv_id, NULL FROM c GROUP BY conv_id HAVING bool_and(speaker = '{SYSTEM}')),
r AS (SELECT n.*, perspective, speaker IS NOT DISTINCT FROM perspective AS own,
             CASE WHEN speaker = '{SYSTEM}' THEN '{START}system' WHEN speaker IS NOT DISTINCT FROM perspective THEN '{START}assistant'
                  ELSE '{START}user name=' || name END || chr(10) AS header FROM n JOIN v ON v.conv_id IS NOT DISTINCT FROM n.conv_id),
s AS (SELECT *, header || text || '{END.strip()}' || chr(10) AS segment FROM r)
SELECT conv_id, perspective, turn, row_number() OVER w AS position, speaker AS role, segment,
       CAST(coalesce(sum(length(segment)) OVER b, 0) AS BIGINT) AS start,
       CAST(coalesce(sum(length(segment)) OVER b, 0) + length(header) AS BIGINT) AS mask_start,
       CAST(CASE WHEN own THEN length(text) + {len(END) - 1} ELSE 0 END AS BIGINT) AS mask_length
FROM s WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(raw)),
              b AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, md5(raw) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
"""
