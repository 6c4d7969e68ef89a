"""The driver's star tables as items, artists, tags and votes, in DataFrames and in SQL.

An order is a track, its customer the first artist, a part's brand (or type) a tag, and the ordered quantity the votes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.operators import votes
from tagloom.sources.sizes import dealt, looked_up, partitions_for


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def votes_long(spark: SparkSession, d: str, tag: str = "p_brand") -> DataFrame:
    """track, artist, tag, votes, in partitions by track."""
    lines, n = tagged_lines(spark, d, tag)
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    # summed by order first: the join with orders then meets one row per (order, tag)
    summed = dealt(lines, n, "l_orderkey").groupBy("l_orderkey", "tag").agg(F.sum("l_quantity").alias("votes"))
    if n is not None:
        orders = orders.repartition(n, "o_orderkey").hint("shuffle_hash")
    return summed.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_orderkey").alias("track"), F.col("o_custkey").alias("artist"), "tag", "votes")


def tagged_lines(spark: SparkSession, d: str, tag: str = "p_brand") -> tuple[DataFrame, int | None]:
    """l_orderkey, tag, l_quantity, and the partitions for a shuffle of them. Rows are counted in the files' footers."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    parts = table(spark, d, "part").select("p_partkey", F.col(tag).alias("tag"))
    rows, size = lines.count(), parts.count()
    joined = looked_up(lines, "l_partkey", parts, "p_partkey", partitions_for(max(rows, size)), size)
    return joined.select("l_orderkey", "tag", "l_quantity"), partitions_for(rows)


def tag_votes(spark: SparkSession, d: str, tag: str = "p_brand") -> DataFrame:
    """track, tag, votes; orders aren't needed."""
    return _tag_votes(tagged_lines(spark, d, tag)[0])


def _tag_votes(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("l_orderkey").alias("track"), "tag", F.col("l_quantity").alias("votes"))


def shares(spark: SparkSession, d: str, tag: str = "p_brand") -> DataFrame:
    """track, tag, p, in partitions by track."""
    lines, n = tagged_lines(spark, d, tag)
    return votes.normalized(_tag_votes(lines), n)


def long_named(spark: SparkSession, d: str) -> DataFrame:
    """votes_long under the long table's column names."""
    return votes_long(spark, d).withColumnsRenamed({"tag": "tag_name", "votes": "tag_count"})


def tracks(spark: SparkSession, d: str) -> DataFrame:
    """track, artist, popularity, year."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("artist"), F.year("o_orderdate").alias("year"))
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("artist"), F.col("c_acctbal").alias("popularity"))
    return orders.join(customers, "artist")


def nested(spark: SparkSession, d: str) -> DataFrame:
    """track, artist, and three tag sets: brands of lines that were returned, types of others, status; sets may be null."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    one = lambda c: F.struct(F.col(c).alias("tag_name"), F.col("l_quantity").alias("tag_count"))
    sets = lines.groupBy(F.col("l_orderkey").alias("track")).agg(
        F.array_sort(F.collect_list(F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 40), one("p_brand")))).alias("track_tags"),
        F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == "A", one("p_type")))).alias("album_tags"),
    )
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("artist"), F.array(F.struct(F.col("o_orderstatus").alias("tag_name"), F.lit(1.0).alias("tag_count"))).alias("artist_tags"))
    return sets.join(orders, F.col("track") == F.col("o_orderkey")).drop("o_orderkey")


def v_sql(tag: str = "p_brand", name: str = "v") -> str:
    return f"{name} AS (SELECT l_orderkey AS track, o_custkey AS artist, {tag} AS tag, sum(l_quantity) AS votes FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3)"


def p_sql(tag: str = "p_brand", v: str = "v", p: str = "p") -> str:
    return f"{v_sql(tag, v)}, {p} AS (SELECT track, tag, votes / sum(votes) OVER (PARTITION BY track) AS p FROM {v})"


def w_sql(tag: str = "p_brand") -> str:
    """v, p, m (marginals), j (sums of products), w (conditional), g (generality), e (edges), u (parent weights)."""
    return f"""{p_sql(tag)},
m AS (SELECT tag, count(*) AS n_tracks, sum(p) AS total, sum(p) / (SELECT count(DISTINCT track) FROM p) AS marginal FROM p GROUP BY tag),
j AS (SELECT x.tag AS a, y.tag AS b, sum(x.p * y.p) AS s FROM p x JOIN p y ON x.track = y.track AND x.tag <> y.tag GROUP BY 1, 2),
w AS (SELECT a, b, s / total AS w FROM j JOIN m ON m.tag = a),
g AS (SELECT m.tag, coalesce(sum(w), 0) AS generality FROM m LEFT JOIN w ON b = m.tag GROUP BY m.tag),
e AS (SELECT a AS from_tag, b AS to_tag, w AS weight FROM w JOIN g ga ON ga.tag = a JOIN g gb ON gb.tag = b WHERE round(ga.generality, 9) < round(gb.generality, 9) AND w > 0),
u AS (SELECT from_tag AS child, to_tag AS parent, weight / sum(weight) OVER (PARTITION BY from_tag) AS w FROM e)"""


def map_sql(folded: str, name: str = "map", paths: str = "paths") -> str:
    """A fixed-set mapping by paths; needs u and g of w_sql and the CTE keyword RECURSIVE. folded: a select of tags."""
    return f"""{paths}(tag, cat, w) AS (SELECT tag, tag, CAST(1.0 AS DOUBLE) FROM g UNION ALL
SELECT {paths}.tag, u.parent, {paths}.w * u.w FROM {paths} JOIN u ON u.child = {paths}.cat WHERE {paths}.cat IN ({folded})),
{name} AS (SELECT tag, cat, sum(w) AS w FROM {paths} WHERE cat NOT IN ({folded}) GROUP BY tag, cat)"""


#: Three least general tags, and another set of three.
LEAST = "SELECT tag FROM g ORDER BY generality, tag LIMIT 3"
OTHER = "SELECT tag FROM (SELECT tag, row_number() OVER (ORDER BY generality, tag) AS i FROM g) x WHERE i IN (1, 2, 4)"


def fold_sql(steps: int) -> str:
    """The greedy fold, step by step, after w_sql: u{i} (weights), q{i} (masses), s{i} (sizes) of state i and c{i}, the tag that step i
    folds. Steps beyond the last fold change nothing, so any number of at least the tags less one will do."""
    sizes = lambda i: f"""s{i} AS MATERIALIZED (SELECT r.tag, count(b.tag) AS n FROM r LEFT JOIN (SELECT q{i}.tag FROM q{i} JOIN r USING (tag) WHERE p > 0
  QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, n_tracks, q{i}.tag) = 1) b ON b.tag = r.tag GROUP BY r.tag)"""  # noqa: E731
    parts = ["r AS MATERIALIZED (SELECT tag, count(*) FILTER (p > 0) AS n_tracks FROM p GROUP BY tag), u0 AS MATERIALIZED (SELECT * FROM u), q0 AS MATERIALIZED (SELECT * FROM p)", sizes(0)]
    for i in range(1, steps + 1):
        j = i - 1
        parts.append(f"""c{i} AS MATERIALIZED (SELECT tag FROM s{j} WHERE tag IN (SELECT child FROM u{j}) ORDER BY n, tag LIMIT 1),
q{i} AS MATERIALIZED (SELECT track, coalesce(parent, q{j}.tag) AS tag, sum(p * coalesce(w, 1)) AS p FROM q{j} LEFT JOIN (SELECT * FROM u{j} WHERE child IN (SELECT tag FROM c{i})) x ON x.child = q{j}.tag GROUP BY 1, 2),
u{i} AS MATERIALIZED (SELECT a.child, coalesce(b.parent, a.parent) AS parent, sum(a.w * coalesce(b.w, 1)) AS w FROM u{j} a LEFT JOIN (SELECT * FROM u{j} WHERE child IN (SELECT tag FROM c{i})) b ON b.child = a.parent
  WHERE a.child NOT IN (SELECT tag FROM c{i}) GROUP BY 1, 2), {sizes(i)}""")
    return ",\n".join(parts)


def fold_states(steps: int, what: str) -> str:
    """One select a state, from 0 on, of those that are reached. `what` may hold {i}, the state, and {f}, the tags folded by then."""
    folded = lambda i: " UNION ALL ".join(f"SELECT tag FROM c{k}" for k in range(1, i + 1)) or "SELECT '' WHERE false"
    return " UNION ALL ".join(f"({what.format(i=i, f=folded(i))}{f' WHERE EXISTS (SELECT * FROM c{i})' if i else ''})" for i in range(steps + 1))
