"""The queries, each next to the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions import stats, text
from tagloom.operators import assign, compare, dag, fold, graphs, ingest, inspect, metagenres, splits, tree_fold, votes
from tagloom.plans.inputs import LEAST, OTHER, fold_sql, fold_states, long_named, map_sql, nested, p_sql, shares, table, tag_votes, tracks, v_sql, votes_long, w_sql
from tagloom.sources import arrow_files, files, gexf
from tagloom.sources.shared import fresh_path, stored
from tagloom.sources.sizes import dealt, partitions_for

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Long tables and filters


@query(f"WITH {v_sql()} SELECT track, artist, tag, votes FROM v")
def votes_table(spark, d):
    return votes_long(spark, d)


def _counts(method: str):
    return lambda spark, d: ingest.count_tags(long_named(spark, d), method).select("track", "tag_name", "tag_count")


for _method, _keys in (("artist", "tag, artist"), ("total", "tag")):
    QUERIES[f"tag_counts_{_method}"] = _counts(_method)
    ORACLES[f"tag_counts_{_method}"] = f"WITH {v_sql()} SELECT track, tag AS tag_name, CAST(count(*) OVER (PARTITION BY {_keys}) AS DOUBLE) AS tag_count FROM v"
QUERIES["tag_counts_ones"] = _counts("ones")
ORACLES["tag_counts_ones"] = f"WITH {v_sql()} SELECT track, tag AS tag_name, CAST(1 AS DOUBLE) AS tag_count FROM v"


@query(f"WITH {v_sql()} SELECT track, tag AS tag_name, votes AS tag_count FROM v WHERE track IN (SELECT track FROM v GROUP BY track HAVING sum(votes) >= 60)")
def min_votes_filter(spark, d):
    return ingest.keep_voted(long_named(spark, d), 60).select("track", "tag_name", "tag_count")


@query(f"WITH {v_sql()} SELECT tag AS tag_name, votes AS tag_count, n_artists FROM v JOIN (SELECT tag, count(DISTINCT artist) AS n_artists FROM v GROUP BY tag HAVING count(DISTINCT artist) >= 900) n USING (tag)")
def min_artists_filter(spark, d):
    return ingest.keep_widespread(long_named(spark, d), 900).select("tag_name", "tag_count", "n_artists")


@query(f"WITH {v_sql()} SELECT track, tag AS tag_name FROM v WHERE tag NOT IN ('Brand#11', 'Brand#12')")
def invalid_tag_filter(spark, d):
    return ingest.drop_tags(long_named(spark, d), ["Brand#11", "Brand#12"]).select("track", "tag_name")


@query("SELECT DISTINCT p_brand AS tag_name FROM part WHERE p_size < 3 AND p_brand NOT IN (SELECT p_brand FROM part WHERE p_size = 50)")
def valid_tags(spark, d):
    part = table(spark, d, "part").select(F.col("p_brand").alias("tag_name"), "p_size")
    return ingest.valid_tags(part, part.where("p_size < 3").select("tag_name"), part.where("p_size = 50").select("tag_name"))


@query("SELECT o_orderkey AS track, o_totalprice, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS priority FROM orders WHERE o_orderkey <> 7 AND (o_totalprice > 100000 OR o_orderstatus = 'O')")
def point_corrections(spark, d):
    orders = table(spark, d, "orders").where("o_orderkey <> 7").where("o_totalprice > 100000 or o_orderstatus = 'O'")
    return orders.select(F.col("o_orderkey").alias("track"), "o_totalprice", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"))


@query("SELECT event_type AS tag_name, count(*) AS n FROM events GROUP BY 1")
def tag_frequencies(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("tag_name")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag_name")


# Nested tag sets

NESTED = """n AS (SELECT l_orderkey AS track,
  list(struct_pack(tag_name := p_brand, tag_count := l_quantity) ORDER BY p_brand, l_quantity) FILTER (l_returnflag = 'R' AND l_quantity > 40) AS t,
  list(struct_pack(tag_name := p_type, tag_count := l_quantity) ORDER BY p_type, l_quantity) FILTER (l_returnflag = 'A') AS a
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1),
c AS (SELECT track, o_custkey AS artist, t, a, CASE WHEN len(t) > 0 THEN t WHEN len(a) > 0 THEN a ELSE [struct_pack(tag_name := o_orderstatus, tag_count := CAST(1 AS DOUBLE))] END AS tags,
  CASE WHEN len(t) > 0 THEN 'track' WHEN len(a) > 0 THEN 'album' ELSE 'artist' END AS tags_source FROM n JOIN orders ON o_orderkey = track)"""


@query(f"WITH {NESTED} SELECT track, tags_source, CAST(len(tags) AS BIGINT) AS n_tags, array_to_string(list_transform(tags, lambda x: x.tag_name), ';') AS names FROM c")
def nested_coalesce(spark, d):
    chosen = ingest.combine_sets(nested(spark, d))
    return chosen.select("track", "tags_source", F.size("tags").cast("long").alias("n_tags"), F.array_join(F.transform("tags", lambda x: x.tag_name), ";").alias("names"))


@query(f"WITH {NESTED}, x AS (SELECT track, artist, tags_source, unnest(tags) AS tag FROM c) SELECT track, tags_source, tag.tag_name AS tag_name, tag.tag_count AS tag_count FROM x")
def nested_to_long(spark, d):
    return ingest.long_tags(ingest.choose_tag_set(nested(spark, d))).select("track", "tags_source", "tag_name", "tag_count")


@query(f"WITH {NESTED} SELECT DISTINCT x.tag_name AS tag_name FROM (SELECT unnest(t) AS x FROM c UNION ALL SELECT unnest(a) FROM c)")
def unique_tags(spark, d):
    return ingest.unique_tags(nested(spark, d), ("track_tags", "album_tags"))


@query("""
WITH s AS (SELECT DISTINCT l_orderkey AS track, l_suppkey AS id FROM lineitem),
a AS (SELECT s_suppkey AS id, 'nation ' || s_nationkey AS g FROM supplier WHERE s_acctbal >= 0 UNION ALL SELECT s_suppkey, CASE WHEN s_acctbal < 5000 THEN 'low' ELSE 'high' END FROM supplier WHERE s_acctbal >= 0)
SELECT track, g AS tag_name, CAST(count(*) AS DOUBLE) AS tag_count FROM s JOIN a USING (id) GROUP BY 1, 2
""")
def nested_artist_union(spark, d):
    """Suppliers in debt are the unknown artists."""
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), "l_suppkey")
    n = partitions_for(lines.count())
    tracks_ = dealt(lines, n, "track").distinct().groupBy("track").agg(F.collect_list(F.struct(F.col("l_suppkey").alias("id"))).alias("artists"))
    genre = lambda x: F.struct(x.alias("genre"))
    level = F.when(F.col("s_acctbal") < 5000, "low").otherwise("high")
    artists = table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("artist_id"), F.array(genre(level), genre(F.concat(F.lit("nation "), "s_nationkey"))).alias("genres"))
    return ingest.unpack_tags(ingest.combine_artist_tags(tracks_, artists, n)).select("track", "tag_name", "tag_count")


@query("""
WITH x AS (SELECT o_orderkey AS track, list(l_suppkey ORDER BY l_linenumber, l_suppkey) AS ids FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT track, o_totalprice AS ab_price, array_to_string(ids, ';') AS track_artist_ids, CAST(len(ids) AS INT) AS n_track_artists, o_orderpriority || '; ' || o_orderstatus AS album_style_text,
 CASE WHEN o_orderstatus = 'O' THEN o_orderstatus END AS album_genre_text, CASE WHEN o_orderstatus = 'O' THEN o_orderstatus || '; ' || o_orderstatus END AS album_first_genre_text
FROM x JOIN orders ON o_orderkey = track
""")
def select_columns(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_suppkey"))).alias("l"))
    orders = table(spark, d, "orders").join(lines, F.col("l_orderkey") == F.col("o_orderkey"))
    raw = orders.select(
        F.col("o_orderkey").alias("track"), F.col("o_totalprice").alias("ab_price"), "o_custkey",
        F.transform("l", lambda x: F.struct(x.l_suppkey.cast("string").alias("id"))).alias("artists"),
        F.array("o_orderpriority", "o_orderstatus").alias("album_styles"),
        F.when(F.col("o_orderstatus") == "O", F.array(F.struct(F.col("o_orderstatus").alias("name")))).otherwise(F.array().cast("array<struct<name:string>>")).alias("album_genres"),
    )
    return ingest.select_columns(raw, ["track"], "ab_")


@query("SELECT c_custkey, unnest(string_split(c_mktsegment || '; ' || CAST(c_nationkey AS VARCHAR), '; ')) AS tag_name FROM customer")
def split_rows(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.concat_ws("; ", "c_mktsegment", "c_nationkey").alias("tag_name"))
    return ingest.split_rows(c, "tag_name")


@query("SELECT l_orderkey, l_linenumber, replace(name, 'l_', '') AS tag_name, value AS tag_count FROM (SELECT l_orderkey, l_linenumber, l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem) UNPIVOT (value FOR name IN (l_discount, l_tax))")
def unpivot_scores(spark, d):
    lines = table(spark, d, "lineitem").withColumn("l_tax", F.nullif("l_tax", F.lit(0.0)))
    return ingest.long_scores(lines, ["l_orderkey", "l_linenumber"], ["l_discount", "l_tax"], "l_")


@query("SELECT o_orderpriority AS x_o_orderpriority, o_orderkey, o_orderstatus AS x_o_orderstatus FROM orders")
def named_columns(spark, d):
    """Columns by a pattern, renamed by a prefix, one moved to the front."""
    chosen = ingest.matching(table(spark, d, "orders"), "^o_order(status|priority)$", ("o_orderkey",))
    return ingest.moved_first(ingest.prefixed(chosen, "x_", ("o_orderkey",)), ["x_o_orderpriority"])


@query("SELECT p_type AS tag_name FROM part UNION SELECT lower(p_type) FROM part UNION SELECT c_mktsegment FROM customer")
def tags_of_two_tables(spark, d):
    types = table(spark, d, "part").select(F.array(F.struct(F.col("p_type").alias("tag_name")), F.struct(F.lower("p_type").alias("tag_name"))).alias("a"))
    segments = table(spark, d, "customer").select(F.array(F.struct(F.col("c_mktsegment").alias("tag_name"))).alias("a"))
    return ingest.unique_tags(types.unionByName(segments), ("a",))


@query("SELECT c_custkey AS id, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, NULL, s_acctbal FROM supplier")
def union_by_name(spark, d):
    return ingest.union_all(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("balance")))


# Strings and places


@query("""SELECT p_partkey, regexp_replace(p_name, '^small ', '') AS removed, replace(replace(replace(replace(replace(p_name, 'ring', '& ring'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '') AS escaped,
 trim(regexp_extract(p_name, '[^ ]+$')) AS last_word, p_name ILIKE '%WIDGET%' AS is_widget, lower(p_type) AS lowered, p_type || ' (' || p_brand || ')' AS label, replace(replace(replace(p_name, ' ', ''), '&', ''), '-', '') AS sanitized,
 CAST(round_even(p_retailprice, 1) AS DOUBLE) AS rounded FROM part""")
def string_projection(spark, d):
    name = F.col("p_name")
    return table(spark, d, "part").select(
        "p_partkey", text.remove_prefix(name, "small ").alias("removed"), text.xml_escaped(F.replace(name, F.lit("ring"), F.lit("& ring"))).alias("escaped"),
        text.last_part(name, " ").alias("last_word"), text.contains(name, "WIDGET").alias("is_widget"), F.lower("p_type").alias("lowered"),
        text.labelled(F.col("p_type"), F.col("p_brand")).alias("label"), text.sanitized(name).alias("sanitized"), F.bround("p_retailprice", 1).alias("rounded"),
    )


@query("""SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 0 THEN 'Port of ' || n_name || ' Bay' ELSE 'Town, ' || n_name END AS origin,
 CASE WHEN n_nationkey % 4 = 0 THEN 'HARBOURS' ELSE n_name END AS country, CASE WHEN n_nationkey % 4 > 0 THEN r_name END AS continent FROM nation JOIN region ON n_regionkey = r_regionkey""")
def classify_region(spark, d):
    """By the last part of a name where that is known, else by the first rule that matches."""
    nation, region = table(spark, d, "nation"), table(spark, d, "region")
    countries = nation.select(F.col("n_name").alias("original"), F.col("n_name").alias("country"))
    continents = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("country"), F.col("r_name").alias("continent"))
    bay = F.concat(F.lit("Port of "), "n_name", F.lit(" Bay"))
    origins = nation.select("n_nationkey", F.when(F.col("n_nationkey") % 4 == 0, bay).otherwise(F.concat(F.lit("Town, "), "n_name")).alias("origin"))
    return ingest.from_origin(origins, countries, continents, [("^Port of ", "HARBOURS"), ("Bay$", "BAYS")]).select("n_nationkey", "origin", "country", "continent")


# Splits

STRATA = """t AS (SELECT o_orderkey AS track, c_custkey AS artist, c_acctbal AS popularity, year(o_orderdate) AS year FROM orders JOIN customer ON c_custkey = o_custkey),
a AS (SELECT artist, median(popularity) AS popularity, median(year) AS year FROM t GROUP BY artist),
q AS (SELECT quantile_cont(popularity, [0, 0.33, 0.66, 1]) AS pb, quantile_cont(year, [0, 0.33, 0.66, 1]) AS yb FROM a),
b AS (SELECT artist, popularity, year, CASE WHEN popularity <= pb[1] THEN NULL WHEN popularity <= pb[2] THEN 1 WHEN popularity <= pb[3] THEN 2 ELSE 3 END AS popularity_bin,
 CASE WHEN year <= yb[1] THEN NULL WHEN year <= yb[2] THEN 1 WHEN year <= yb[3] THEN 2 ELSE 3 END AS year_bin FROM a, q),
s AS (SELECT *, coalesce(CAST(popularity_bin AS VARCHAR), 'NA') || '_' || coalesce(CAST(year_bin AS VARCHAR), 'NA') AS stratum FROM b),
h AS (SELECT artist, stratum, row_number() OVER (PARTITION BY stratum ORDER BY (artist * 2654435761 + 42) % 1000, artist) <= floor(count(*) OVER (PARTITION BY stratum) * 0.8) AS is_train FROM s)"""


@query(f"WITH {STRATA} SELECT artist, popularity, CAST(year AS DOUBLE) AS year, popularity_bin, year_bin, stratum FROM s")
def artist_strata(spark, d):
    return splits.artist_strata(tracks(spark, d))


@query(f"WITH {STRATA} SELECT artist, stratum, is_train FROM h")
def artist_split(spark, d):
    return splits.stratified_split(splits.artist_strata(tracks(spark, d)))


@query(f"WITH {STRATA} SELECT is_train, count(*) AS n_tracks, count(DISTINCT artist) AS n_artists FROM t JOIN h USING (artist) GROUP BY 1")
def split_tracks(spark, d):
    all_ = tracks(spark, d)
    train, test = splits.split_tracks(all_, splits.stratified_split(splits.artist_strata(all_)))
    count = lambda df, name: df.agg(F.count("*").alias("n_tracks"), F.countDistinct("artist").alias("n_artists")).select(F.lit(name).alias("is_train"), "*")
    return count(train, True).unionByName(count(test, False))


@query(f"WITH {v_sql()}, c AS (SELECT tag, track % 2 AS half FROM v GROUP BY 1, 2 HAVING count(DISTINCT artist) >= 650) SELECT tag AS tag_name FROM c GROUP BY tag HAVING count(*) = 2")
def common_tags(spark, d):
    long = long_named(spark, d)
    return splits.common_tags(long.where("track % 2 = 0"), long.where("track % 2 = 1"), 650)


@query(f"""WITH {v_sql()}, e AS (SELECT track, artist, tag AS tag_name FROM v), c AS (SELECT tag_name, track % 2 AS half FROM e GROUP BY 1, 2 HAVING count(DISTINCT artist) >= 650)
SELECT track, tag_name FROM e WHERE tag_name IN (SELECT tag_name FROM c GROUP BY 1 HAVING count(*) = 2)""")
def external_restricted(spark, d):
    """Rows of a long table whose tag is common among its artists in either set of tracks."""
    long = long_named(spark, d)
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("track"))
    return splits.restricted(long, orders.where("track % 2 = 0"), orders.where("track % 2 = 1"), 650).select("track", "tag_name")


# Votes and the graph


@query(f"WITH {p_sql()} SELECT track, tag, round(p, 6) AS p FROM p")
def normalized_votes(spark, d):
    return rounded(shares(spark, d), "p")


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"WITH {p_sql('p_type')} SELECT track, " + ", ".join(f"round(coalesce(sum(p) FILTER (tag = '{t}'), 0), 6) AS \"{t}\"" for t in TYPES) + " FROM p GROUP BY track")
def vote_matrix_wide(spark, d):
    return rounded(votes.wide(shares(spark, d, "p_type"), TYPES), *TYPES)


@query(f"WITH {w_sql()} SELECT tag, n_tracks, round(total, 6) AS total, round(marginal, 6) AS marginal FROM m")
def tag_marginals(spark, d):
    return rounded(votes.marginals(shares(spark, d)), "total", "marginal")


@query(f"WITH {w_sql()} SELECT a, b, round(s / (SELECT count(DISTINCT track) FROM p), 6) AS joint FROM j")
def joint(spark, d):
    return rounded(votes.joint(shares(spark, d)), "joint")


@query(f"WITH {w_sql()} SELECT a, b, round(w, 6) AS w FROM w")
def conditional(spark, d):
    return rounded(votes.conditional(shares(spark, d)), "w")


@query(f"WITH {w_sql()} SELECT tag, round(generality, 6) AS generality FROM g")
def generality(spark, d):
    return rounded(votes.generality(shares(spark, d)), "generality")


@query(f"WITH {w_sql()} SELECT tag, round(generality, 6) AS generality FROM g ORDER BY generality DESC, tag LIMIT 20")
def top_generality(spark, d):
    return rounded(votes.most_general(votes.generality(shares(spark, d))), "generality")


@query(f"WITH {w_sql()} SELECT from_tag, to_tag, round(weight, 6) AS weight FROM e")
def dag_edges(spark, d):
    return rounded(dag.edges(shares(spark, d)), "weight")


@query(f"WITH {w_sql()} SELECT tag FROM g WHERE tag NOT IN (SELECT from_tag FROM e)")
def dag_roots(spark, d):
    p = shares(spark, d)
    return dag.roots(p.select("tag").distinct(), dag.edges(p))


@query(f"WITH {w_sql()} SELECT child, parent, round(w, 6) AS w FROM u")
def parent_weights(spark, d):
    return rounded(dag.parent_weights(dag.edges(shares(spark, d))), "w")


@query(f"WITH {w_sql('p_type')} SELECT from_tag, to_tag, round(weight, 6) AS weight FROM e WHERE weight > 0.1")
def strong_edges(spark, d):
    return rounded(dag.strong_edges(dag.edges(shares(spark, d, "p_type"))), "weight")


@query(f"WITH {p_sql('p_type')} SELECT track, tag, round(p, 6) AS p FROM p WHERE tag IN (SELECT tag FROM p GROUP BY tag HAVING min(p) < 1)")
def always_alone_tags(spark, d):
    alone = table(spark, d, "customer").select((-1 - F.col("c_custkey")).alias("track"), F.col("c_mktsegment").alias("tag"), F.lit(1.0).alias("p"))
    return rounded(ingest.drop_always_alone(shares(spark, d, "p_type").unionByName(alone)), "p")


# The fold


class _Types:
    """Votes on types, their pairs and their graph, each stored once; the votes with a row for each track, so that neither the pairs nor
    the fold shuffle them by track again."""

    def __init__(self, spark: SparkSession, d: str, tag: str = "p_type"):
        self.rows = stored(votes.by_track(shares(spark, d, tag)), "shares")
        self.p = self.rows.select("track", F.explode("v").alias("x")).select("track", "x.tag", "x.p")
        w = stored(votes.conditional(self.p, self.rows), "pairs")
        self.edges = stored(dag.edges(self.p, w), "edges")
        self.generality = votes.generality(self.p, w)
        self.tags = stored(self.p.select("tag").distinct(), "tags")
        self._order: list[str] | None = None

    def folded(self, places: tuple[int, ...] = (0, 1, 2)) -> list[str]:
        """Tags by their place in order of generality."""
        if self._order is None:
            self._order = [r.tag for r in self.generality.orderBy("generality", "tag").collect()]
        return [self._order[i] for i in places if i < len(self._order)]

    def mapping(self, places: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
        return stored(fold.paths_mapping(dag.parent_weights(self.edges), self.tags, self.folded(places)), "mapping")

    def probabilities(self, places: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
        return assign.probabilities(self.p, self.mapping(places))

    def state(self) -> fold.Folding:
        return fold.fold(self.p, self.edges, rows=self.rows)


def _fold(spark: SparkSession, d: str, part: str, tag: str = "p_type") -> DataFrame:
    return fold.tables(spark, _Types(spark, d, tag).state())[part]


FOLD = f"{w_sql('p_type')}, {fold_sql(5)}"
ORDER = " UNION ALL ".join("SELECT {i} AS step, tag FROM c{i}".replace("{i}", str(i)) for i in range(1, 6))
GINI = "SELECT {i} AS step, (2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*)) * count(*) / (count(*) - 1) AS gini, count(*) AS k FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM s{i} WHERE tag NOT IN ({f})) x"


@query(f"WITH {FOLD} SELECT CAST(step AS INT) AS step, tag FROM ({ORDER}) o")
def fold_order(spark, d):
    return _fold(spark, d, "order")


@query(f"WITH {FOLD} SELECT CAST(step AS INT) AS step, tag, n FROM ({fold_states(5, 'SELECT {i} AS step, tag, n FROM s{i}')}) o")
def fold_sizes(spark, d):
    return _fold(spark, d, "sizes")


@query(f"WITH {FOLD} SELECT CAST(k AS INT) AS k, round(gini, 6) AS gini FROM ({fold_states(5, f'SELECT * FROM ({GINI}) g')}) o WHERE k > 1")
def fold_ginis(spark, d):
    return rounded(inspect.gini_series(_fold(spark, d, "ginis")), "gini")


@query(f"WITH {w_sql()}, {fold_sql(24)} SELECT CAST(step AS INT) AS step, tag FROM ({' UNION ALL '.join(f'SELECT {i} AS step, tag FROM c{i}' for i in range(1, 25))}) o")
def fold_order_brands(spark, d):
    return _fold(spark, d, "order", "p_brand")


@query(f"WITH {FOLD} SELECT 'size' AS part, tag AS a, NULL AS b, CAST(n AS DOUBLE) AS value FROM s3 WHERE n > 0 UNION ALL SELECT 'edge', child, parent, round(w, 6) FROM u3 WHERE round(w, 6) >= 0.3")
def k_categories(spark, d):
    """The state after three folds: categories that hold tracks, and the graph's edges from a threshold on."""
    state = _Types(spark, d).state()
    sizes = spark.createDataFrame([*state.sizes_at(3).items()], "cat string, n long")
    graph = rounded(fold.graph_table(spark, state, max(len(state.roots), len(state.tags) - 3)), "weight")
    some, edges = inspect.solution(sizes, graph)
    text = lambda c: F.col(c).alias(c)
    return some.select(F.lit("size").alias("part"), F.col("cat").alias("a"), F.lit(None).cast("string").alias("b"), F.col("n").cast("double").alias("value")).unionByName(
        edges.select(F.lit("edge").alias("part"), F.col("from_tag").alias("a"), F.col("to_tag").alias("b"), F.col("weight").alias("value")).select(*map(text, ("part", "a", "b", "value")))
    )


MAP = f"{w_sql('p_type')}, {map_sql(LEAST)}"


@query(f"WITH RECURSIVE {MAP} SELECT tag, cat, round(w, 6) AS w FROM map")
def fold_mapping_fixed_set(spark, d):
    return rounded(_Types(spark, d).mapping(), "w")


@query(f"WITH RECURSIVE {MAP} SELECT tag, cat, round(w, 6) AS w FROM map")
def fold_mapping_closed_form(spark, d):
    types = _Types(spark, d)
    state = fold.start(types.p, types.edges)
    return rounded(spark.createDataFrame(state.mapping(types.folded()), "tag string, cat string, w double"), "w")


PROBS = f"{MAP}, q AS (SELECT track, cat, sum(p * w) AS p FROM p JOIN map USING (tag) GROUP BY 1, 2), best AS (SELECT track, cat, p AS cat_prob FROM q QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, cat) = 1)"


@query(f"WITH RECURSIVE {PROBS} SELECT track, cat, round(p, 6) AS p FROM q")
def track_probs(spark, d):
    return rounded(_Types(spark, d).probabilities(), "p")


@query(f"WITH RECURSIVE {PROBS} SELECT track, cat, round(cat_prob, 6) AS cat_prob FROM best")
def track_label(spark, d):
    return rounded(assign.labels(_Types(spark, d).probabilities()), "cat_prob")


@query(f"WITH RECURSIVE {PROBS} SELECT track, artist, tag, cat FROM v LEFT JOIN best USING (track)")
def long_with_labels(spark, d):
    return assign.add_to_long(votes_long(spark, d, "p_type"), assign.labels(_Types(spark, d).probabilities())).select("track", "artist", "tag", "cat")


SIZES = f"{p_sql()}, r AS (SELECT tag, count(*) AS n_tracks FROM p GROUP BY tag), x AS (SELECT tag FROM p JOIN r USING (tag) QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, n_tracks, tag) = 1), z AS (SELECT r.tag AS cat, count(x.tag) AS n FROM r LEFT JOIN x ON x.tag = r.tag GROUP BY 1)"


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    p = shares(spark, d)
    return assign.hard_sizes(p.withColumnRenamed("tag", "cat"), assign.rarity(p), p.select(F.col("tag").alias("cat")).distinct())


@query(f"WITH {SIZES} SELECT cat, n FROM z")
def hard_sizes(spark, d):
    return _sizes(spark, d)


@query(f"WITH {SIZES}, y AS (SELECT n, row_number() OVER (ORDER BY n) AS i FROM z) SELECT round((2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*)) * count(*) / (count(*) - 1), 6) AS gini FROM y")
def gini_sizes(spark, d):
    return rounded(stats.gini(_sizes(spark, d), "n"), "gini")


@query(f"WITH {SIZES} SELECT tag, n_tracks, rank() OVER (ORDER BY n_tracks) + (count(*) OVER (PARTITION BY n_tracks) - 1) / 2.0 AS rank FROM r")
def tag_rarity(spark, d):
    return assign.rarity(shares(spark, d))


# Comparison

TWO = f"{p_sql('p_type', 'v1', 'p1')}, {p_sql('p_brand', 'v2', 'p2')}"


DENSE = """t AS (SELECT DISTINCT track FROM p1),
d1 AS (SELECT t.track, c.tag, coalesce(p, 0) AS p FROM t CROSS JOIN (SELECT DISTINCT tag FROM p1) c LEFT JOIN p1 ON p1.track = t.track AND p1.tag = c.tag),
d2 AS (SELECT t.track, c.tag, coalesce(p, 0) AS p FROM t CROSS JOIN (SELECT DISTINCT tag FROM p2) c LEFT JOIN p2 ON p2.track = t.track AND p2.tag = c.tag),
r1 AS (SELECT track, tag, rank() OVER (PARTITION BY tag ORDER BY p) + (count(*) OVER (PARTITION BY tag, p) - 1) / 2.0 AS r FROM d1),
r2 AS (SELECT track, tag, rank() OVER (PARTITION BY tag ORDER BY p) + (count(*) OVER (PARTITION BY tag, p) - 1) / 2.0 AS r FROM d2),
x AS (SELECT r1.tag AS a, r2.tag AS b, round(corr(r1.r, r2.r), 6) AS corr FROM r1 JOIN r2 USING (track) GROUP BY 1, 2)"""


@query(f"WITH {TWO}, {DENSE} SELECT a, b, corr FROM x")
def spearman_block(spark, d):
    first, second = (shares(spark, d, t).withColumnRenamed("tag", "cat") for t in ("p_type", "p_brand"))
    return rounded(stats.spearman_block(first, second), "corr")


@query(f"WITH {p_sql('p_type', 'v1', 'p1')}, p2 AS (SELECT * FROM p1), {DENSE} SELECT a, b, corr FROM x")
def posterior_correlation(spark, d):
    q = stored(shares(spark, d, "p_type").withColumnRenamed("tag", "cat"), "shares")
    return rounded(inspect.posterior(q, q.select("cat").distinct())["correlation"], "corr")


SQUARE = f"{p_sql('p_type', 'v1', 'p1')}, p2 AS (SELECT * FROM p1), {DENSE}"


def _square(spark: SparkSession, d: str) -> DataFrame:
    q = stored(shares(spark, d, "p_type").withColumnRenamed("tag", "cat"), "shares")
    return stored(rounded(stats.spearman_block(q, q), "corr"), "correlation")


def _power_sql(name: str, matrix: str) -> str:
    unit = "list_transform(y, lambda x: coalesce(x / nullif(sqrt(list_dot_product(y, y)), 0), 0))"
    return f"""{name}0(r, v) AS (SELECT 0, list_transform(range(0, n), lambda i: 1 + i / n) FROM {matrix} UNION ALL SELECT r + 1, {unit} FROM (SELECT r, list_transform(m, lambda z: list_dot_product(z, v)) AS y FROM {name}0, {matrix} WHERE r < {compare.ROUNDS}) w),
{name} AS (SELECT {unit} AS v FROM (SELECT v AS y FROM {name}0 WHERE r = {compare.ROUNDS}) w)"""


_SIGNED = "list_transform({v}, lambda x: x * coalesce(sign(list_filter({v}, lambda y: abs(y) >= list_max(list_transform({v}, lambda w: abs(w))) - 1e-9)[1]), 1))"


@query(f"""WITH RECURSIVE {SQUARE}, rw AS (SELECT a, list(coalesce(corr, 0) ORDER BY b) AS r FROM x GROUP BY a), mt AS MATERIALIZED (SELECT list(a ORDER BY a) AS names, list(r ORDER BY a) AS m, len(list(a)) AS n FROM rw),
{_power_sql("f", "mt")}, la AS (SELECT f.v, list_dot_product(f.v, list_transform(m, lambda z: list_dot_product(z, f.v))) AS l FROM f, mt),
mu AS MATERIALIZED (SELECT names, n, list_transform(range(1, n + 1), lambda i: list_transform(range(1, n + 1), lambda j: m[i][j] - l * v[i] * v[j])) AS m FROM mt, la), {_power_sql("g2", "mu")},
bo AS (SELECT names, {_SIGNED.replace("{v}", "f.v")} AS e1, {_SIGNED.replace("{v}", "g2.v")} AS e2 FROM mt, f, g2), ea AS (SELECT unnest(names) AS cat, unnest(e1) AS e1, unnest(e2) AS e2 FROM bo),
an AS (SELECT *, CASE WHEN e1 = 0 THEN sign(e2) * pi() / 2 ELSE atan(e2 / e1) END + CASE WHEN e1 > 0 THEN 0 ELSE pi() END AS angle FROM ea)
SELECT cat, round(e1, 5) + 0.0 AS e1, round(e2, 5) + 0.0 AS e2, round(angle, 5) AS angle, CAST(row_number() OVER (ORDER BY round(angle, 9), cat) AS INT) AS place FROM an""")
def eigen_order(spark, d):
    return compare.eigen_order(_square(spark, d)).select("cat", *((F.round(c, 5) + 0.0).alias(c) for c in ("e1", "e2", "angle")), "place")


def _ward_sql(items: int) -> str:
    parts = ["wc0 AS MATERIALIZED (SELECT a AS id, 1 AS size, a AS leaf, 0 AS born FROM x GROUP BY a)", "wd0 AS MATERIALIZED (SELECT a, b, (1 - corr) * (1 - corr) AS d FROM x WHERE a <> b)"]
    for i in range(items - 1):
        parts.append(f"""wm{i} AS MATERIALIZED (SELECT p.id AS a, q.id AS b, d, p.size AS na, q.size AS nb, CASE WHEN (p.born, p.id) < (q.born, q.id) THEN p.leaf || ';' || q.leaf ELSE q.leaf || ';' || p.leaf END AS leaf FROM wd{i} e JOIN wc{i} p ON p.id = e.a JOIN wc{i} q ON q.id = e.b WHERE e.a < e.b ORDER BY d, e.a, e.b LIMIT 1),
wc{i + 1} AS MATERIALIZED (SELECT * FROM wc{i} WHERE id NOT IN (SELECT a FROM wm{i} UNION ALL SELECT b FROM wm{i}) UNION ALL SELECT a, na + nb, leaf, {i + 1} FROM wm{i}),
wn{i} AS MATERIALIZED (SELECT k.id AS k, wm{i}.a AS z, ((na + k.size) * da.d + (nb + k.size) * db.d - k.size * wm{i}.d) / (na + nb + k.size) AS d FROM wm{i} JOIN wc{i} k ON k.id <> wm{i}.a AND k.id <> wm{i}.b JOIN wd{i} da ON da.a = wm{i}.a AND da.b = k.id JOIN wd{i} db ON db.a = wm{i}.b AND db.b = k.id),
wd{i + 1} AS MATERIALIZED (SELECT e.* FROM wd{i} e, wm{i} WHERE e.a NOT IN (wm{i}.a, wm{i}.b) AND e.b NOT IN (wm{i}.a, wm{i}.b) UNION ALL SELECT k, z, d FROM wn{i} UNION ALL SELECT z, k, d FROM wn{i})""")
    merges = " UNION ALL ".join(f"SELECT 'merge' AS part, {i + 1} AS place, array_to_string(list_sort(string_split(leaf, ';')), ';') AS name, round(sqrt(d), 6) AS height FROM wm{i}" for i in range(items - 1))
    return f"{', '.join(parts)}, lf AS (SELECT string_split(leaf, ';') AS l FROM wc{items - 1}) {merges} UNION ALL SELECT 'leaf', CAST(generate_subscripts(l, 1) AS INT), unnest(l), NULL FROM lf"


@query(f"WITH {SQUARE}, {_ward_sql(6)}")
def cluster_order(spark, d):
    return rounded(compare.clustered(_square(spark, d)), "height")


@query(f"""WITH {TWO}, {DENSE}, l1 AS (SELECT tag, count(*) AS n FROM (SELECT tag FROM p1 QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, tag) = 1) y GROUP BY 1),
l2 AS (SELECT tag, count(*) AS n FROM (SELECT tag FROM p2 QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, tag) = 1) y GROUP BY 1),
b AS (SELECT 'a' AS side, coalesce(n, 0) AS n FROM (SELECT DISTINCT tag FROM p1) t LEFT JOIN l1 USING (tag) UNION ALL SELECT 'b', coalesce(n, 0) FROM (SELECT DISTINCT tag FROM p2) t LEFT JOIN l2 USING (tag)),
o AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY n) AS i FROM b)
SELECT side, round((2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*)) * count(*) / (count(*) - 1), 6) AS gini FROM o GROUP BY side""")
def correlation_ginis(spark, d):
    first, second = (shares(spark, d, t).withColumnRenamed("tag", "cat") for t in ("p_type", "p_brand"))
    return rounded(compare.correlation_table(first, second)["ginis"], "gini")


@query(f"""WITH {TWO}, {DENSE},
l1 AS (SELECT tag, count(*) AS n FROM (SELECT tag FROM p1 QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, tag) = 1) y GROUP BY 1),
l2 AS (SELECT tag, count(*) AS n FROM (SELECT tag FROM p2 QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, tag) = 1) y GROUP BY 1)
SELECT a, b, corr, round(coalesce(l1.n, 0) / (SELECT sum(n) FROM l1), 6) AS prev_a, round(coalesce(l2.n, 0) / (SELECT sum(n) FROM l2), 6) AS prev_b
FROM x LEFT JOIN l1 ON l1.tag = a LEFT JOIN l2 ON l2.tag = b""")
def correlation_table(spark, d):
    first, second = (shares(spark, d, t).withColumnRenamed("tag", "cat") for t in ("p_type", "p_brand"))
    return rounded(compare.correlation_table(first, second)["cells"], "corr", "prev_a", "prev_b")


RAREST = f"{v_sql()}, c AS (SELECT tag, count(*) AS n FROM v GROUP BY tag), k AS (SELECT track, tag AS ext_cat FROM v JOIN c USING (tag) QUALIFY row_number() OVER (PARTITION BY track ORDER BY n, tag) = 1)"


def _rarest(spark: SparkSession, d: str) -> DataFrame:
    return compare.rarest_category(votes_long(spark, d).select("track", "tag"))


@query(f"WITH {RAREST} SELECT track, ext_cat AS cat FROM k")
def rarest_category_per_track(spark, d):
    return _rarest(spark, d)


@query(f"""WITH {RAREST}, {p_sql('p_type', 'v1', 'p1')}, n AS (SELECT ext_cat, count(*) AS n FROM k GROUP BY 1),
s AS (SELECT ext_cat, tag, sum(p) AS s FROM k JOIN p1 USING (track) GROUP BY 1, 2),
best AS (SELECT tag FROM p1 QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, tag) = 1),
z AS (SELECT tag, count(*) / sum(count(*)) OVER () AS share FROM best GROUP BY 1)
SELECT n.ext_cat, z.tag AS cat, round(coalesce(s, 0) / n, 6) AS mean_prob, round(n / sum(n) OVER (PARTITION BY z.tag), 6) AS prev_ext, round(share, 6) AS prev_cat
FROM n CROSS JOIN z LEFT JOIN s ON s.ext_cat = n.ext_cat AND s.tag = z.tag""")
def mean_prob_by_category(spark, d):
    q = shares(spark, d, "p_type").withColumnRenamed("tag", "cat")
    return rounded(compare.mean_probabilities(_rarest(spark, d), q, q.select("cat").distinct()), "mean_prob", "prev_ext", "prev_cat")


@query(f"WITH RECURSIVE {PROBS}, c AS (SELECT g.tag AS cat, count(best.cat) AS n FROM g LEFT JOIN best ON best.cat = g.tag GROUP BY 1) SELECT cat, n, round(n / sum(n) OVER (), 6) AS share FROM c")
def prevalences(spark, d):
    cats = shares(spark, d, "p_type").select(F.col("tag").alias("cat")).distinct()
    return rounded(assign.prevalences(assign.labels(_Types(spark, d).probabilities()), cats), "share")


PAIR = f"{w_sql('p_type')}, {map_sql(LEAST, 'm1', 'x1')}, {map_sql(OTHER, 'm2', 'x2')}"
CELLS = "c AS (SELECT coalesce(m1.tag, m2.tag) AS tag, coalesce(m1.cat, m2.cat) AS cat, coalesce(m1.w, 0) AS x, coalesce(m2.w, 0) AS y FROM m1 FULL JOIN m2 ON m1.tag = m2.tag AND m1.cat = m2.cat)"


@query(f"WITH RECURSIVE {PAIR}, {CELLS} SELECT tag, round(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2, 6) AS jsd FROM c GROUP BY tag")
def jsd_columns(spark, d):
    types = _Types(spark, d)
    return rounded(stats.jensen_shannon(types.mapping(), types.mapping((0, 1, 3))), "jsd")


T_TEST = "s0 AS (SELECT avg(x - y) AS mean, avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))) AS t, count(*) - 1 AS df FROM c), s AS (SELECT *, atan(abs(t) / sqrt(df)) AS th FROM s0)"
#: Student's distribution in closed form for whole degrees of freedom: a sum of powers of the cosine.
STUDENT = """CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + sin(th) * coalesce(list_sum(list_transform(range(0, (df - 1) // 2), lambda k: power(cos(th), 2 * k + 1) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: 2.0 * i / (2 * i + 1))), 1))), 0))
ELSE sin(th) * list_sum(list_transform(range(0, df // 2), lambda k: power(cos(th), 2 * k) * coalesce(list_product(list_transform(range(1, k + 1), lambda i: (2.0 * i - 1) / (2 * i))), 1))) END"""


@query(f"WITH RECURSIVE {PAIR}, {CELLS}, {T_TEST} SELECT round(mean, 6) + 0.0 AS mean, round(t, 4) + 0.0 AS t, df, round(1 - {STUDENT}, 6) AS p FROM s")
def flatdiff_ttest_stat(spark, d):
    types = _Types(spark, d)
    found = stats.t_statistic(compare.mapping_differences(types.mapping(), types.mapping((0, 1, 3))), "d")
    found = found.withColumn("p", stats.t_p_value("t", "df"))
    return found.select((F.round("mean", 6) + 0.0).alias("mean"), (F.round("t", 4) + 0.0).alias("t"), "df", F.round("p", 6).alias("p"))


F1 = """l1 AS (SELECT track, cat FROM (SELECT track, cat, sum(p * w) AS p FROM p JOIN m1 USING (tag) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, cat) = 1),
l2 AS (SELECT track, cat FROM (SELECT track, cat, sum(p * w) AS p FROM p JOIN m2 USING (tag) GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, cat) = 1),
b AS (SELECT l1.cat AS t, l2.cat AS g FROM l1 JOIN l2 USING (track)), f AS (SELECT t, 2.0 * count(*) FILTER (t = g) / (count(*) + (SELECT count(*) FROM b z WHERE z.g = b.t)) AS f FROM b GROUP BY t)"""


@query(f"WITH RECURSIVE {PAIR}, {F1} SELECT round(avg(f), 6) AS macro_f1 FROM f")
def macro_f1(spark, d):
    types = _Types(spark, d)
    return rounded(compare.robustness(types.p, types.mapping(), types.mapping((0, 1, 3)))["f1"], "macro_f1")


@query(f"""WITH RECURSIVE {PAIR}, {CELLS}, {F1},
jd AS (SELECT tag, sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2 AS jsd FROM c GROUP BY tag)
SELECT 'divergence' AS measure, tag AS of, round(jsd, 6) AS value FROM jd UNION ALL SELECT 'f1', '', round(avg(f), 6) FROM f
UNION ALL SELECT 'mean', '', round(avg(x - y), 6) + 0.0 FROM c UNION ALL SELECT 'df', '', count(*) - 1.0 FROM c UNION ALL SELECT 't', '', round(avg(x - y) / (stddev_samp(x - y) / sqrt(count(*))), 4) + 0.0 FROM c""")
def robustness_bundle(spark, d):
    """All measures of how far two foldings agree, as rows."""
    types = _Types(spark, d)
    found = compare.robustness(types.p, types.mapping(), types.mapping((0, 1, 3)))
    test = found["test"].select(F.posexplode(F.array(F.round("mean", 6) + 0.0, F.round("t", 4) + 0.0, F.col("df").cast("double"))).alias("i", "value"))
    row = lambda df, measure, of, value: df.select(F.lit(measure).alias("measure") if isinstance(measure, str) else measure.alias("measure"), of.alias("of"), value.alias("value"))
    return (
        row(found["divergence"], "divergence", F.col("tag"), F.round("jsd", 6))
        .unionByName(row(found["f1"], "f1", F.lit(""), F.round("macro_f1", 6)))
        .unionByName(row(test, F.array(F.lit("mean"), F.lit("t"), F.lit("df"))[F.col("i")], F.lit(""), F.col("value")))
    )


@query(f"""WITH RECURSIVE {PROBS}, x AS (SELECT best.*, o_custkey AS artist, o_totalprice AS popularity FROM best JOIN orders ON o_orderkey = track),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY cat, artist ORDER BY round(cat_prob, 12) DESC, popularity DESC, track) = 1)
SELECT cat, CAST(row_number() OVER w AS INT) AS place, track, artist, round(cat_prob, 6) AS cat_prob, popularity FROM y WINDOW w AS (PARTITION BY cat ORDER BY round(cat_prob, 12) DESC, popularity DESC, track) QUALIFY row_number() OVER w <= 2""")
def example_tracks(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("artist"), F.col("o_totalprice").alias("popularity"))
    return rounded(inspect.example_tracks(assign.labels(_Types(spark, d).probabilities()).join(orders, "track")), "cat_prob")


@query(f"""WITH RECURSIVE {PROBS}, x AS (SELECT best.*, o_custkey AS artist, o_totalprice AS popularity FROM best JOIN orders ON o_orderkey = track WHERE cat_prob < 1),
y AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY cat, artist ORDER BY round(cat_prob, 12) DESC, popularity DESC, track) = 1)
SELECT cat, CAST(row_number() OVER w AS INT) AS place, track, artist, round(cat_prob, 6) AS cat_prob, popularity FROM y WINDOW w AS (PARTITION BY cat ORDER BY round(cat_prob, 12) DESC, popularity DESC, track) QUALIFY row_number() OVER w <= 3""")
def example_tracks_mixed(spark, d):
    """As example_tracks, three of each, without tracks that lie in one category alone."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("artist"), F.col("o_totalprice").alias("popularity"))
    return rounded(inspect.example_tracks(assign.labels(_Types(spark, d).probabilities()).join(orders, "track"), 3, mixed_only=True), "cat_prob")


@query(f"WITH {p_sql('p_type')}, best AS (SELECT round(max(p), 9) AS m FROM p GROUP BY track) SELECT CAST(floor(m / 0.0625) AS BIGINT) AS bin, count(*) AS n FROM best GROUP BY 1")
def prob_histogram(spark, d):
    best = assign.labels(shares(spark, d, "p_type"), "tag").withColumn("cat_prob", F.round("cat_prob", 9))
    return stats.histogram(best, "cat_prob", 0.0, 0.0625)


@query(f"WITH {p_sql('p_type')}, best AS (SELECT max(p) AS m FROM p GROUP BY track) SELECT round(median(m), 6) AS median_max_prob FROM best")
def median_max_prob(spark, d):
    return rounded(inspect.median_probability(stored(assign.labels(shares(spark, d, "p_type"), "tag"), "labels")), "median_max_prob")


# Trees and small graphs

ADJ = f"{v_sql('p_type')}, o AS (SELECT DISTINCT track, tag FROM v), k AS (SELECT tag, count(*) AS m FROM o GROUP BY 1), a AS (SELECT x.tag AS a, y.tag AS b, count(*) / max(m) AS w FROM o x JOIN o y ON x.track = y.track AND x.tag <> y.tag JOIN k ON k.tag = x.tag GROUP BY 1, 2), n AS (SELECT a.a, a.b, greatest(0, a.w - coalesce(z.w, 0)) AS w FROM a LEFT JOIN a z ON z.a = a.b AND z.b = a.a), tree AS (SELECT a, b, w FROM n WHERE w > 0 QUALIFY row_number() OVER (PARTITION BY a ORDER BY w DESC, b) = 1)"


@query(f"WITH {v_sql('p_type')} SELECT x.track, x.tag AS a, y.tag AS b FROM v x JOIN v y ON x.track = y.track AND x.tag <> y.tag")
def tag_pairs(spark, d):
    return graphs.tag_pairs(votes_long(spark, d, "p_type"))


@query(f"WITH {ADJ} SELECT a, b, round(w, 6) AS w FROM a")
def tag_adjacency(spark, d):
    return rounded(graphs.adjacency(tag_votes(spark, d, "p_type")), "w")


@query(f"WITH {v_sql('p_type')}, k AS (SELECT tag, count(*) AS m FROM v GROUP BY 1) SELECT x.tag AS a, y.tag AS b, round(sum(y.votes / (x.votes + y.votes)) / max(m), 6) AS w FROM v x JOIN v y ON x.track = y.track AND x.tag <> y.tag JOIN k ON k.tag = x.tag GROUP BY 1, 2")
def vote_weighted(spark, d):
    return rounded(graphs.vote_weighted(votes_long(spark, d, "p_type")), "w")


@query(f"WITH {ADJ} SELECT a, b, round(w, 6) AS w FROM n")
def net_direction(spark, d):
    return rounded(graphs.net_direction(graphs.adjacency(tag_votes(spark, d, "p_type"))), "w")


@query(f"WITH {ADJ} SELECT a, b, round(w, 6) AS w FROM tree")
def strongest_parent(spark, d):
    return rounded(graphs.strongest_parent(graphs.net_direction(graphs.adjacency(tag_votes(spark, d, "p_type")))), "w")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    return stored(graphs.build_tree(tag_votes(spark, d, "p_type")), "tree")


LEVELS = f"{ADJ}, l(tag_name, hierarchy_level) AS (SELECT b, 0 FROM tree WHERE b NOT IN (SELECT a FROM tree) UNION SELECT tree.a, hierarchy_level + 1 FROM l JOIN tree ON tree.b = tag_name)"


@query(f"WITH RECURSIVE {LEVELS} SELECT tag_name, CAST(hierarchy_level AS INT) AS hierarchy_level FROM l")
def hierarchy_level(spark, d):
    tree = _tree(spark, d)
    return graphs.levels(tree, graphs.root_of(tree))


@query(f"WITH RECURSIVE {LEVELS} SELECT tag_name FROM l")
def descendants(spark, d):
    tree = _tree(spark, d)
    return graphs.descendants(tree, graphs.root_of(tree))


@query(f"WITH {ADJ}, f AS (SELECT min(a) AS f FROM tree) SELECT 'focus' AS relation, f AS tag_name, NULL::DOUBLE AS weight FROM f UNION ALL SELECT 'parent', b, round(w, 6) FROM tree, f WHERE a = f UNION ALL SELECT 'child', a, round(w, 6) FROM tree, f WHERE b = f")
def genealogy(spark, d):
    tree = _tree(spark, d)
    return rounded(graphs.family(tree, tree.agg(F.min("from_tag")).first()[0]), "weight")


@query(f"WITH {p_sql('p_type')} SELECT tag, round(sum(p), 6) AS size FROM p GROUP BY tag UNION ALL SELECT 'ROOT', 0.001")
def tag_sizes(spark, d):
    return rounded(graphs.tag_sizes(shares(spark, d, "p_type")), "size")


@query(f"WITH {ADJ} SELECT a || '->' || b AS key, round(w, 6) AS weight FROM tree")
def edge_keys(spark, d):
    return rounded(graphs.edge_keys(_tree(spark, d)), "weight")


@query("SELECT p_type AS tag, CASE WHEN p_type = 'PROMO' THEN '#000000' ELSE '#808080' END AS fill FROM part GROUP BY p_type")
def tag_fills(spark, d):
    return graphs.fills(table(spark, d, "part").select(F.col("p_type").alias("tag")).distinct(), "PROMO")


DEPTH = 6  # six types: a tree of at most five levels below its root


def _deep_sql() -> str:
    """The tree fold, level by level, after LEVELS: z (min_n, tag, cat) and y (min_n, n_metagenres, weighted_gini)."""
    now = "CASE WHEN EXISTS (SELECT * FROM h{j} h WHERE h.min_n = g.min_n AND h.tag = x.tag) THEN x.s ELSE x.n END"
    steps = [f"h{DEPTH} AS (SELECT 0 AS min_n, '' AS tag WHERE false)"]
    for i in range(DEPTH - 1, -1, -1):
        n = now.replace("{j}", str(i + 1))
        steps.append(f"h{i} AS MATERIALIZED (SELECT * FROM h{i + 1} UNION ALL SELECT DISTINCT g.min_n, x.parent FROM x, grid g WHERE x.lvl = {i} AND x.parent IS NOT NULL AND {n} > 0 AND {n} < g.min_n)")
    return f"""top AS (SELECT max(m) AS top FROM k), grid AS (SELECT DISTINCT CAST(unnest(list_append(range(1, top + 1, greatest(1, top // 20)), top)) AS BIGINT) AS min_n FROM top),
up(tag, anc) AS (SELECT tag_name, tag_name FROM l UNION ALL SELECT up.tag, tree.b FROM up JOIN tree ON tree.a = up.anc),
x AS MATERIALIZED (SELECT l.tag_name AS tag, tree.b AS parent, hierarchy_level AS lvl, coalesce(k.m, 0) AS n, (SELECT coalesce(sum(k2.m), 0) FROM up JOIN k k2 ON k2.tag = up.tag WHERE up.anc = l.tag_name) AS s FROM l LEFT JOIN tree ON tree.a = l.tag_name LEFT JOIN k ON k.tag = l.tag_name),
{", ".join(steps)},
z0 AS (SELECT g.min_n, x.tag, coalesce((SELECT arg_min(h.tag, a.lvl) FROM h0 h JOIN up ON up.tag = x.tag AND up.anc = h.tag JOIN x a ON a.tag = h.tag WHERE h.min_n = g.min_n), x.tag) AS cat FROM x, grid g WHERE x.tag IN (SELECT tag FROM k)),
q AS (SELECT min_n, cat, sum(k.m) AS n, max(c.lvl) + 1 AS w FROM z0 JOIN k USING (tag) JOIN x c ON c.tag = z0.cat GROUP BY 1, 2),
q2 AS (SELECT *, coalesce(sum(n * w) OVER (PARTITION BY min_n ORDER BY n, w, cat ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q),
y0 AS (SELECT min_n, CAST(count(*) AS INT) AS n_metagenres, CASE WHEN count(*) > 1 THEN greatest(0, 1 - sum(w * (2 * before + n * w)) / (sum(w) * sum(n * w))) END AS weighted_gini FROM q2 GROUP BY 1),
y AS (SELECT * FROM y0 WHERE min_n < (SELECT coalesce(min(min_n), 9223372036854775807) FROM y0 WHERE weighted_gini IS NULL)), z AS (SELECT * FROM z0 WHERE min_n IN (SELECT min_n FROM y))"""


def _tuned(spark: SparkSession, d: str, part: str) -> DataFrame:
    tree = _tree(spark, d)
    sizes = stored(tag_votes(spark, d, "p_type").groupBy("tag").agg(F.countDistinct("track").alias("n")), "tag-sizes")
    top = sizes.agg(F.max("n")).first()[0] or 0
    grid = tree_fold.search_grid(1, None, max(1, top // 20), top)
    return tree_fold.tune(tree_fold.tour(tree, graphs.root_of(tree)), sizes, grid)[part]


@query(f"WITH RECURSIVE {LEVELS}, {_deep_sql()} SELECT min_n, n_metagenres, round(weighted_gini, 6) AS weighted_gini FROM y")
def tree_fold_grid(spark, d):
    return rounded(_tuned(spark, d, "ginis"), "weighted_gini")


@query(f"WITH RECURSIVE {LEVELS}, {_deep_sql()} SELECT min_n, tag, cat FROM z")
def tree_fold_solutions(spark, d):
    return _tuned(spark, d, "solutions")


@query(f"""WITH RECURSIVE {LEVELS}, c0 AS (SELECT tag_name AS tag, '{{"name":"' || tag_name || '","size":' || k.m || ',"fill":"' || CASE WHEN hierarchy_level = 0 THEN '#000000' ELSE '#808080' END || '"' AS head, hierarchy_level AS lvl, tree.b AS parent FROM l JOIN k ON k.tag = tag_name LEFT JOIN tree ON tree.a = tag_name),
j{DEPTH} AS (SELECT '' AS tag, '' AS parent, '' AS json WHERE false), {", ".join(f"""j{i} AS (SELECT tag, parent, head || coalesce(',"children":[' || (SELECT string_agg(json, ',' ORDER BY j.tag) FROM j{i + 1} j WHERE j.parent = c0.tag) || ']', '') || '}}' AS json FROM c0 WHERE lvl = {i})""" for i in range(DEPTH - 1, -1, -1))}
SELECT tag AS root, json FROM j0""")
def tag_hierarchy(spark, d):
    """The tree of types as nested JSON, its root in black."""
    tree = _tree(spark, d)
    sizes = tag_votes(spark, d, "p_type").groupBy("tag").agg(F.countDistinct("track").alias("size"))
    children = tree.select(F.col("from_tag").alias("tag"), F.lit(graphs.GREY).alias("fill"))
    nodes = sizes.join(children, "tag", "left").select("tag", "size", F.coalesce("fill", F.lit(graphs.BLACK)).alias("fill"))
    return graphs.hierarchies(tree, nodes)


BAD = """ends AS (SELECT min_n, min(tag) AS first, arg_max(cat, tag) AS other FROM z GROUP BY 1), zz AS (SELECT z.*, first, other FROM z JOIN ends USING (min_n)),
bad AS (SELECT 'good' AS "case", min_n, tag, cat FROM z UNION ALL SELECT 'lost', min_n, tag, cat FROM zz WHERE tag <> first UNION ALL SELECT 'twice', min_n, tag, cat FROM zz UNION ALL SELECT 'twice', min_n, tag, cat FROM zz WHERE tag = first
 UNION ALL SELECT 'moved', min_n, tag, CASE WHEN tag = first THEN other ELSE cat END FROM zz UNION ALL SELECT 'unfolded', min_n, tag, tag FROM zz),
held AS (SELECT "case", min_n, cat, sum(k.m) AS n FROM bad JOIN k USING (tag) GROUP BY 1, 2, 3)"""


@query(f"""WITH RECURSIVE {LEVELS}, {_deep_sql()}, {BAD}
SELECT "case", c.min_n, 'lost' AS rule, k.tag FROM (SELECT DISTINCT "case", min_n FROM bad) c, k WHERE NOT EXISTS (SELECT * FROM bad b WHERE b."case" = c."case" AND b.min_n = c.min_n AND b.tag = k.tag)
UNION ALL SELECT "case", min_n, 'twice', tag FROM bad GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT DISTINCT "case", min_n, 'stray', b.tag FROM bad b WHERE NOT EXISTS (SELECT * FROM up WHERE up.tag = b.tag AND up.anc = b.cat)
UNION ALL SELECT "case", min_n, 'parent', h.cat FROM held h JOIN x ON x.tag = h.cat JOIN k ON k.tag = x.parent WHERE k.m > 0 AND NOT EXISTS (SELECT * FROM held p WHERE p."case" = h."case" AND p.min_n = h.min_n AND p.cat = x.parent)
UNION ALL SELECT "case", min_n, 'small', h.cat FROM held h JOIN x ON x.tag = h.cat WHERE x.parent IS NOT NULL AND h.n > 0 AND h.n < min_n""")
def fold_violations(spark, d):
    """What the checkers find in the tree folds (nothing) and in failing cases made of them."""
    tree = _tree(spark, d)
    places = tree_fold.tour(tree, graphs.root_of(tree))
    sizes = stored(tag_votes(spark, d, "p_type").groupBy("tag").agg(F.countDistinct("track").alias("n")), "tag-sizes")
    good = stored(_tuned(spark, d, "solutions"), "solutions")
    cases = splits.broken_folds(good).unionByName(good.select(F.lit("good").alias("case"), "min_n", "tag", "cat"))
    return splits.fold_violations(cases, places, sizes, ("case", "min_n")).select("case", "min_n", "rule", "tag")


@query("WITH t AS (SELECT DISTINCT p_type AS tag FROM part) SELECT x.tag AS a, y.tag AS b, CAST(0 AS DOUBLE) AS w FROM t x CROSS JOIN t y")
def empty_adjacency(spark, d):
    return graphs.empty_pairs(table(spark, d, "part").select(F.col("p_type").alias("tag")))


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def factor_cleaning(spark, d):
    """Factors with a single level go; others stay."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.lit("only").alias("level"), (F.col("o_totalprice") < 0).alias("free"))
    return splits.without_constants(rows, ["o_orderstatus", "o_orderpriority", "level", "free"])


ROUNDS = 16  # more than the edges beyond a spanning tree of six vertices in both directions could make necessary
#: Steps from one type to the next within an order, by priority: five graphs with several cycles each; an edge is what one direction has more.
STEPS = """n0 AS (SELECT o_orderpriority || ':' || p_type AS tag, lead(o_orderpriority || ':' || p_type) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, p_type) AS then_tag FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
n1 AS (SELECT tag AS a, then_tag AS b, count(*) AS w FROM n0 WHERE tag <> then_tag GROUP BY 1, 2), e AS MATERIALIZED (SELECT x.a, x.b, CAST(x.w - coalesce(y.w, 0) AS DOUBLE) AS w FROM n1 x LEFT JOIN n1 y ON y.a = x.b AND y.b = x.a WHERE x.w > coalesce(y.w, 0)),
t AS MATERIALIZED (SELECT a, b FROM e WHERE substr(b, 1, 1) IN ('1', '3') QUALIFY row_number() OVER (PARTITION BY a ORDER BY a < b DESC, w DESC, b) = 1 AND a < b)"""


def _cycles_sql() -> str:
    parts = ["e0 AS (SELECT * FROM e)"]
    for i in range(ROUNDS):
        parts.append(f"""r{i}(a, b) AS (SELECT a, b FROM e{i} UNION SELECT r.a, e{i}.b FROM r{i} r JOIN e{i} ON e{i}.a = r.b),
m{i} AS MATERIALIZED (SELECT x.a, min(x.b) AS part FROM r{i} x JOIN r{i} y ON y.a = x.b AND y.b = x.a GROUP BY 1),
d{i} AS (SELECT f.a, f.b FROM e{i} f JOIN m{i} p ON p.a = f.a JOIN m{i} q ON q.a = f.b AND q.part = p.part WHERE NOT EXISTS (SELECT * FROM t WHERE t.a = f.a AND t.b = f.b) QUALIFY row_number() OVER (PARTITION BY p.part ORDER BY f.w, f.a, f.b) = 1),
e{i + 1} AS MATERIALIZED (SELECT * FROM e{i} f WHERE NOT EXISTS (SELECT * FROM d{i} d WHERE d.a = f.a AND d.b = f.b))""")
    return ", ".join(parts)


def _steps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Edges of the graphs of steps, and trees in two of them: of each tag its heaviest edge to a later name."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(table(spark, d, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).withColumn("tag", F.concat("o_orderpriority", F.lit(":"), "p_type"))
    after = F.lead("tag").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "p_type"))
    steps = rows.withColumn("b", after).where("tag <> b").groupBy(F.col("tag").alias("a"), "b").agg(F.count("*").cast("double").alias("w"))
    edges = stored(graphs.net_direction(steps).where("w > 0").toDF("from_tag", "to_tag", "weight"), "steps")
    some = edges.where("from_tag < to_tag and substr(to_tag, 1, 1) in ('1', '3')").withColumnsRenamed({"from_tag": "a", "to_tag": "b", "weight": "w"})
    return edges, graphs.strongest_parent(some).select(F.col("a").alias("from_tag"), F.col("b").alias("to_tag"))


@query(f"WITH RECURSIVE {STEPS}, {_cycles_sql()} SELECT a AS from_tag, b AS to_tag, w AS weight FROM e{ROUNDS}")
def without_cycles(spark, d):
    return graphs.without_cycles(*_steps(spark, d))


SERIES = "s AS (SELECT CAST(p_size AS INT) AS n_metagenres, CAST(count(*) AS DOUBLE) AS weighted_gini FROM part GROUP BY 1), x AS (SELECT *, lag(weighted_gini) OVER (ORDER BY n_metagenres) AS b, lead(weighted_gini) OVER (ORDER BY n_metagenres) AS a FROM s), c AS (SELECT n_metagenres, weighted_gini FROM x WHERE weighted_gini < b AND weighted_gini < a)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    return tree_fold.local_minima(table(spark, d, "part").groupBy(F.col("p_size").alias("n_metagenres")).agg(F.count("*").cast("double").alias("weighted_gini")))


@query(f"WITH {SERIES} SELECT n_metagenres, weighted_gini FROM c")
def local_minima(spark, d):
    return _series(spark, d)


@query(f"WITH {SERIES} SELECT n_metagenres, weighted_gini FROM c WHERE n_metagenres <= 30 ORDER BY n_metagenres >= 20 DESC, CASE WHEN n_metagenres >= 20 THEN weighted_gini END, n_metagenres DESC LIMIT 1")
def suggested_solution(spark, d):
    return tree_fold.suggested(_series(spark, d), 20, 30)


# Metagenres, folds and levels

META = f"{v_sql()}, k AS (SELECT *, CASE WHEN CAST(substr(tag, 7) AS INT) < 9 THEN 'Low & Mid' WHEN CAST(substr(tag, 7) AS INT) < 17 THEN 'Mid-High' ELSE 'Top' END AS metagenre FROM v), n AS (SELECT track, metagenre, sum(votes) AS n FROM k GROUP BY 1, 2), s AS (SELECT *, n / sum(n) OVER (PARTITION BY track) AS p FROM n), z AS (SELECT metagenre, sum(n) AS size FROM n GROUP BY 1), h AS (SELECT track, metagenre FROM s JOIN z USING (metagenre) QUALIFY row_number() OVER (PARTITION BY track ORDER BY round(p, 12) DESC, size, metagenre) = 1)"
METAGENRES = ["Low & Mid", "Mid-High", "Top"]


def _metagenre(tag: str) -> F.Column:
    number = F.substring(tag, 7, 9).cast("int")
    return F.when(number < 9, METAGENRES[0]).when(number < 17, METAGENRES[1]).otherwise(METAGENRES[2])


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    return votes_long(spark, d).withColumn("metagenre", _metagenre("tag"))


@query(f"WITH {META}, w AS (SELECT track, " + ", ".join(f"round(coalesce(sum({k}) FILTER (metagenre = '{m}'), 0), 6) AS {k}_{metagenres.sanitized(m)}" for k in "pn" for m in METAGENRES) + ", max(n) AS n_max, round(max(p), 6) AS p_max FROM s GROUP BY track) SELECT * FROM w JOIN h USING (track)")
def metagenre_map(spark, d):
    mapping = table(spark, d, "part").select(F.col("p_brand").alias("tag")).distinct().select("tag", _metagenre("tag").alias("metagenre"))
    out = metagenres.mapped(votes_long(spark, d), mapping, METAGENRES)
    return rounded(out, *(c for c in out.columns if c[:2] in ("p_", "n_") and c != "n_max"))


@query(f"WITH {META} SELECT track, metagenre, n, round(p, 6) AS p FROM s")
def metagenre_prevalences(spark, d):
    return rounded(metagenres.prevalences(_mapped(spark, d)), "p")


@query(f"WITH {META} SELECT track, metagenre FROM h")
def hard_class_tie(spark, d):
    return metagenres.hard_classes(metagenres.prevalences(_mapped(spark, d)))


@query("""
WITH x AS (SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS part, CASE WHEN o_totalprice > 480000 THEN 'huge' WHEN o_orderkey % 7 = 3 AND o_orderkey % 5 > 0 THEN 'odd' ELSE o_orderstatus END AS grp FROM orders)
SELECT o_orderkey, part, CASE WHEN grp = 'odd' OR (grp = 'huge' AND (SELECT min(n) FROM (SELECT count(*) FILTER (grp = 'huge') AS n FROM x GROUP BY part)) < 5) THEN 'other' WHEN grp = (SELECT grp FROM x WHERE grp <> 'odd' GROUP BY grp HAVING min(grp) <> 'huge' OR (SELECT min(n) FROM (SELECT count(*) FILTER (grp = 'huge') AS n FROM x GROUP BY part)) >= 5 ORDER BY count(*), grp LIMIT 1) THEN 'other' ELSE grp END AS grp FROM x
""")
def rare_level_remap(spark, d):
    status = F.when(F.col("o_totalprice") > 480000, "huge").when((F.col("o_orderkey") % 7 == 3) & (F.col("o_orderkey") % 5 > 0), "odd").otherwise(F.col("o_orderstatus"))
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("part"), status.alias("grp"))
    # `odd` is absent from the test part; `other` is then absent there too, unless another level joins it
    return splits.remap_rare(rows, "grp", "part", 5)


@query("SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END AS split_type, o_orderkey % 3 AS split_id, o_orderstatus AS cat, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY CASE WHEN o_orderkey % 5 = 0 THEN 'test' ELSE 'train' END, o_orderkey % 3), 6) AS share FROM orders GROUP BY 1, 2, 3")
def split_distribution(spark, d):
    rows = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 == 0, "test").otherwise("train").alias("split_type"), (F.col("o_orderkey") % 3).alias("split_id"), F.col("o_orderstatus").alias("cat"))
    return rounded(splits.distribution(rows), "share")


@query("SELECT o_orderstatus, o_orderpriority, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*) AS n FROM orders GROUP BY 1, 2")
def split_summary(spark, d):
    return rounded(splits.summary(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], "o_totalprice"), "mean", "sd", digits=4)


@query("SELECT o_orderkey AS track, o_custkey AS artist, (o_custkey * 2654435761 + 42) % 1000003 % 5 AS fold FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY (o_orderkey * 2654435761 + 42) % 1000, o_orderkey) <= 4")
def artist_cv_folds(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("track"), F.col("o_custkey").alias("artist"))
    return splits.capped_folds(rows, 5, 4)


# Files


@query(f"WITH {v_sql('p_type')} SELECT CAST(track AS VARCHAR) AS track, CAST(artist AS VARCHAR) AS artist, tag AS tag_name, votes AS tag_count FROM v")
def csv_round_trip(spark, d):
    path = fresh_path(spark, "csv")
    files.write_csv(votes_long(spark, d, "p_type").select(F.col("track").cast("string"), F.col("artist").cast("string"), F.col("tag").alias("tag_name"), F.col("votes").alias("tag_count")), path)
    return files.read_csv(spark, path, files.LONG)


@query(f"WITH {w_sql('p_type')} SELECT from_tag, to_tag, round(weight, 6) AS weight FROM e")
def gexf_round_trip(spark, d):
    p = stored(shares(spark, d, "p_type"), "shares")
    path = gexf.write_gexf(p.select("tag"), dag.edges(p), "types", fresh_path(spark, "gexf-folder"))
    return rounded(gexf.read_gexf(spark, path)[1], "weight")


@query(f"WITH {NESTED} SELECT track, tags_source, unnest(tags).tag_name AS tag_name, unnest(tags).tag_count AS tag_count FROM c")
def arrow_round_trip(spark, d):
    path = fresh_path(spark, "arrow")
    arrow_files.write_arrow(ingest.choose_tag_set(nested(spark, d)).select("track", "tags_source", F.col("tags").alias("list of.tags")), path)
    back = arrow_files.read_arrow(spark, path)
    return back.select("track", "tags_source", F.explode("`list of.tags`").alias("x")).select("track", "tags_source", "x.tag_name", "x.tag_count")


@query("SELECT DISTINCT p_type AS intern, lower(p_type) AS print FROM part")
def lookup_round_trip(spark, d):
    path = fresh_path(spark, "lookup")
    files.write_csv(table(spark, d, "part").select(F.col("p_type").alias("intern"), F.lower("p_type").alias("print")).distinct(), path, ";")
    return files.read_lookup(spark, path)


@query(f"WITH {NESTED} SELECT track, CAST(len(tags) AS INT) AS n_tags FROM c")
def nested_round_trip(spark, d):
    path = fresh_path(spark, "nested")
    files.write_table(ingest.choose_tag_set(nested(spark, d)).select("track", "tags"), path)
    return files.read_table(spark, path).select("track", F.size("tags").alias("n_tags"))
