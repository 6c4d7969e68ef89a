"""Quality rules with thresholds that follow each language and source.

Every text gives integer metrics. Their distribution per (lang, source) is kept as a log-linear histogram: a quantile
sketch whose buckets are counts, so partial sketches merge by addition, in any order and with one result. Quantiles have
a relative error under 1/256. The quartiles make a fence in place of each metric's fixed cutoff: it lies REACH times their distance
beyond them. Junk moves no quartile until it is a quarter of a group, however far out it lies. Where the quartiles are as good as equal, their distance
counts as a least spread, so that a uniform group isn't cut by a hundredth of a character: a few steps for lengths, and for what most texts have none of
(symbols, repeats) a part of the amount at which the tail begins, the lower quartile of the rows above zero.

A group's quartiles are its own from MIN_GROUP rows on, and its tail from MIN_TAIL rows above zero on; below, the merged sketch of the language
stands in, then that of the table. A group without quartiles, even there, has no fences. Rows that fail the base rules stay out of the sketches.

Defined cases: null and empty texts have no words and fail the base rules; null lang or source is a group of its own;
repeated rows count as often as they occur; with fewer than MIN_GROUP rows past the base rules there are no fences and
nothing else fails. A text of any length is one row: its words and windows are held by one task, some 100 bytes a word.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.llm.common import stored, without_blanks, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
#: Rows that a group needs for quartiles of its own, and rows above zero for a tail of its own.
MIN_GROUP, MIN_TAIL = 100, 12
#: Spreads by which a fence lies beyond the quartiles.
REACH = 5
#: Metric: (least spread, that as twentieths of the tail's lower quartile, has a lower fence). Lengths are in hundredths of a character, shares per mille.
METRICS = {"word_len": (8, 0, True), "symbol_share": (0, 1, False), "dup_line_share": (0, 16, False), "repeat_share": (0, 60, False)}
#: Exact buckets below this value, then 256 to 511 buckets for each doubling.
EXACT = 512
#: Shares of a hot (lang, source) in the join with its thresholds.
SALTS = 64


def repeated_words(words: str) -> Column:
    """Words of the array column that lie in a 5-word window found twice or more."""
    window = ", ".join(f"{words}[i + {k}]" for k in range(WINDOW))
    hashes = f"if(size({words}) < {WINDOW}, array(), transform(sequence(0, size({words}) - {WINDOW}), i -> xxhash64({window})))"
    # Only a text whose hashes repeat is sorted: equal ones then stand side by side. Their windows are sorted once more as texts
    # (words hold no blanks), so that none counts by its hash alone, and the places that are left are merged.
    twins = lambda s: f"filter({s}, (x, k) -> (k > 0 and {s}[k - 1].h = x.h) or (k < size({s}) - 1 and {s}[k + 1].h = x.h))"
    texts = f"array_sort(transform(transform({twins('s')}, x -> x.i), i -> struct(concat_ws(' ', {window}) as h, i)))"
    places = f"array_sort(transform({twins('t')}, x -> x.i))"
    covered = f"aggregate({places}, struct(0L as n, {-WINDOW} as last), (a, p) -> struct(a.n + least({WINDOW}, p - a.last) as n, p as last), a -> a.n)"
    by_sort = f"transform(transform(array(array_sort(transform(hs, (h, i) -> struct(h, i)))), s -> {texts}), t -> {covered})[0]"
    return F.expr(f"transform(array({hashes}), hs -> if(size(array_distinct(hs)) = size(hs), 0L, {by_sort}))[0]")


def base_metrics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the metrics of the whole texts."""
    text = docs.select("doc_id", "lang", "source", F.coalesce("text", F.lit("")).alias("t")).withColumn("w", words_of(F.col("t")))
    lines = F.expr("filter(split(t, '\\n', -1), l -> length(trim(' \\t\\u000B\\u000C\\r', l)) > 0)")
    counted = text.select(
        "doc_id", "lang", "source",
        F.size("w").cast("long").alias("n_words"),
        F.char_length(without_blanks(F.col("t"))).cast("long").alias("word_chars"),
        sum(((F.char_length("t") - F.char_length(F.replace(F.col("t"), F.lit(c), F.lit("")))) for c in SYMBOLS), F.lit(0)).cast("long").alias("n_symbols"),
        lines.alias("lines"),
        repeated_words("w").alias("n_repeat_words"),
    )
    return counted.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("lines").cast("long").alias("n_lines"),
    )


def _over(of: str, per: str, scale: int) -> Column:
    return F.expr(f"{scale} * {of} div greatest(1, {per})")


def with_rules(metrics: DataFrame) -> DataFrame:
    return metrics.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        _over("word_chars", "n_words", 100).alias("word_len"),
        _over("n_symbols", "word_chars", 1000).alias("symbol_share"),
        _over("n_dup_lines", "n_lines", 1000).alias("dup_line_share"),
        _over("n_repeat_words", "n_words", 1000).alias("repeat_share"),
    )


def bucket_sql(value: str) -> str:
    """Least value of the sketch's bucket, in plain SQL. Values from EXACT * 2**40 share the last width."""
    width = " ".join(f"WHEN {value} < {EXACT << k} THEN {value} - {value} % {1 << k}" for k in range(41))
    return f"CASE {width} ELSE {value} - {value} % {1 << 41} END"


def sketches(rows: DataFrame) -> DataFrame:
    """level, lang, source, metric, bucket, n: the sketch of each group, and merged per language and overall."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.expr(bucket_sql(m)).alias("bucket")) for m in METRICS)))
    fine = rows.select("lang", "source", pairs.alias("p")).select("lang", "source", "p.*").groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    levels = F.expr(
        "explode(array(named_struct('level', 0, 'lang', lang, 'source', source), named_struct('level', 1, 'lang', lang, 'source', cast(null as string)), "
        "named_struct('level', 2, 'lang', cast(null as string), 'source', cast(null as string))))"
    )
    return fine.select(levels.alias("g"), "metric", "bucket", "n").groupBy("g.level", "g.lang", "g.source", "metric", "bucket").agg(F.sum("n").alias("n"))


def fences(sketch: DataFrame) -> DataFrame:
    """level, lang, source, n_rows, and per metric m: q1_m and q3_m (quartiles), some_m (rows above zero) and tail_m (their lower quartile)."""
    group = ["level", "lang", "source", "metric"]
    by = W.partitionBy(*group)
    upto = sketch.select(
        "*",
        F.sum("n").over(by.orderBy("bucket")).alias("upto"),
        F.sum("n").over(by).alias("all"),
        F.sum(F.when(F.col("bucket") == 0, F.col("n")).otherwise(0)).over(by).alias("zeros"),
    )
    quartile = lambda q: F.min(F.when(4 * F.col("upto") >= q * F.col("all"), F.col("bucket")))
    tail = F.min(F.when((F.col("bucket") > 0) & (4 * (F.col("upto") - F.col("zeros")) >= F.col("all") - F.col("zeros")), F.col("bucket")))
    of_metric = upto.groupBy(*group).agg(quartile(1).alias("q1"), quartile(3).alias("q3"), tail.alias("tail"), F.max("all").alias("n_rows"), F.max(F.col("all") - F.col("zeros")).alias("some"))
    return of_metric.groupBy("level", "lang", "source").agg(
        F.max("n_rows").alias("n_rows"),
        *(F.max(F.when(F.col("metric") == m, F.col(c))).alias(f"{c}_{m}") for m in METRICS for c in ("q1", "q3", "some", "tail")),
    )


def _bounds(levels: list[str]) -> list[Column]:
    """low_m and high_m of each metric, from structs of fences(): own, language's, table's. Null where there is none."""
    found = []
    for m, (least, twentieths, _) in METRICS.items():
        q1, q3 = (F.coalesce(*(F.when(F.col(f"{x}.n_rows") >= MIN_GROUP, F.col(f"{x}.{c}_{m}")) for x in levels)) for c in ("q1", "q3"))
        tail = F.coalesce(*(F.when(F.col(f"{x}.some_{m}") >= MIN_TAIL, F.col(f"{x}.tail_{m}")) for x in levels), F.lit(0))
        spread = REACH * F.greatest(20 * (q3 - q1), F.lit(20 * least), twentieths * tail) / 20.0
        found += [(q1 - spread).alias(f"low_{m}"), F.when((q3 > 0) | (spread > 0), q3 + spread).alias(f"high_{m}")]
    return found


def thresholds(found: DataFrame) -> DataFrame:
    """lang, source, threshold_level (of the quartiles: 0 source, 1 language, 2 table; null: no fences), low_m and high_m of every group of fences()."""
    values = [c for c in found.columns if c not in ("level", "lang", "source")]
    own = found.where(F.col("level") == 0).select("lang", "source", F.struct(*values).alias("f0"))
    by_lang = found.where(F.col("level") == 1).select(F.col("lang").alias("lang1"), F.struct(*values).alias("f1"))
    overall = found.where(F.col("level") == 2).select(F.struct(*values).alias("f2"))  # one row
    three = own.join(by_lang, F.col("lang").eqNullSafe(F.col("lang1"))).join(F.broadcast(overall))
    level = F.coalesce(*(F.when(F.col(f"f{k}.n_rows") >= MIN_GROUP, k) for k in range(3)))
    return three.select("lang", "source", level.alias("threshold_level"), *_bounds(["f0", "f1", "f2"]))


def adaptive_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, lang, source, the metrics, base_failed, kept, threshold_level."""
    rows = stored(with_rules(base_metrics(docs)), "quality-metrics")
    found = stored(fences(sketches(rows.where("not base_failed"))), "quality-fences")
    chosen = thresholds(found).withColumnsRenamed({"lang": "g_lang", "source": "g_source"}).withColumn("g_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    joined = salted.join(chosen, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")) & (F.col("salt") == F.col("g_salt")), "left")
    inside = [F.col(m) <= F.col(f"high_{m}") for m in METRICS] + [F.col(m) >= F.col(f"low_{m}") for m, (*_, lower) in METRICS.items() if lower]
    ok = reduce(lambda a, b: a & b, (F.coalesce(x, F.lit(True)) for x in inside))
    return joined.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ok).alias("kept"), "threshold_level")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return adaptive_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    fails = " OR ".join([f"coalesce({m} > high_{m}, false)" for m in METRICS] + [f"coalesce({m} < low_{m}, false)" for m, (*_, lower) in METRICS.items() if lower])
    levels = "SELECT 0 AS level, lang, source, * EXCLUDE (lang, source) FROM v UNION ALL SELECT 1, lang, NULL, * EXCLUDE (lang, source) FROM v UNION ALL SELECT 2, NULL, NULL, * EXCLUDE (lang, source) FROM v"
    quartile = lambda m, q: f"list_sort(list({bucket_sql(m)}))[CAST(ceil({q} * count(*) / 4.0) AS BIGINT)]"
    tail = lambda m: f"list_sort(list({bucket_sql(m)}) FILTER ({m} > 0))[CAST(ceil(count(*) FILTER ({m} > 0) / 4.0) AS BIGINT)]"
    quartiles = ", ".join(f"{quartile(m, 1)} AS q1_{m}, {quartile(m, 3)} AS q3_{m}, count(*) FILTER ({m} > 0) AS some_{m}, {tail(m)} AS tail_{m}" for m in METRICS)
    first = lambda n, least, c: ", ".join(f"CASE WHEN {x}.{n} >= {least} THEN {x}.{c} END" for x in "okt")
    of = lambda m, q: f"coalesce({first('n_rows', MIN_GROUP, f'{q}_{m}')})"
    spread = lambda m: f"{REACH} * greatest(20 * ({of(m, 'q3')} - {of(m, 'q1')}), {20 * METRICS[m][0]}, {METRICS[m][1]} * coalesce({first(f'some_{m}', MIN_TAIL, f'tail_{m}')}, 0)) / 20.0"
    bounds = ", ".join(f"{of(m, 'q1')} - {spread(m)} AS low_{m}, CASE WHEN {of(m, 'q3')} > 0 OR {spread(m)} > 0 THEN {of(m, 'q3')} + {spread(m)} END AS high_{m}" for m in METRICS)
    return rf"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
f AS (SELECT doc_id, i, word, count(*) OVER five AS m, string_agg(word, ' ') OVER five AS win FROM p
      WINDOW five AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
r AS (SELECT doc_id, i, m = {WINDOW} AND count(*) OVER (PARTITION BY doc_id, win) > 1 AS rep FROM f),
c AS (SELECT doc_id, i, max(CAST(rep AS INT)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS covered FROM r),
n AS (SELECT doc_id, sum(covered) AS n_repeat_words FROM c GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) - len(list_distinct(lines)) AS n_dup_lines, len(lines) AS n_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN n USING (doc_id)),
m AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words AS base_failed,
             100 * word_chars // greatest(1, n_words) AS word_len, 1000 * n_symbols // greatest(1, word_chars) AS symbol_share,
             1000 * n_dup_lines // greatest(1, n_lines) AS dup_line_share, 1000 * n_repeat_words // greatest(1, n_words) AS repeat_share FROM b),
v AS (SELECT * FROM m WHERE NOT base_failed),
l AS ({levels}),
q AS (SELECT level, lang, source, count(*) AS n_rows, {quartiles} FROM l GROUP BY level, lang, source),
h AS (SELECT o.lang AS g_lang, o.source AS g_source, {bounds}
      FROM q o JOIN q k ON k.level = 1 AND k.lang IS NOT DISTINCT FROM o.lang JOIN q t ON t.level = 2 WHERE o.level = 0)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT ({fails}) AS kept
FROM m LEFT JOIN h ON g_lang IS NOT DISTINCT FROM lang AND g_source IS NOT DISTINCT FROM source
"""


ORACLE = _oracle()
