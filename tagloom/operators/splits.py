"""Artist-disjoint, stratified splits and the thresholds that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.functions.ranks import quantiles
from tagloom.operators.ingest import keep_widespread
from tagloom.sources.shared import stored

BREAKS = (0.0, 0.33, 0.66, 1.0)


def binned(x: Column, breaks: Column) -> Column:
    """1, 2, 3 for (b0, b1], (b1, b2], (b2, b3]; null at or below the least break."""
    return F.when(x <= breaks[0], None).when(x <= breaks[1], 1).when(x <= breaks[2], 2).when(x <= breaks[3], 3)


def artist_strata(tracks: DataFrame, *, check: bool = True) -> DataFrame:
    """artist, popularity, year (medians), their bins by terciles over the artists, and stratum "p_y" (a null bin is NA).

    The breaks are exact and come from a distributed selection; equal breaks can't make bins: with check, that is an error."""
    artists = stored(tracks.groupBy("artist").agg(F.median("popularity").alias("popularity"), F.median("year").alias("year")), "artists")
    breaks = {name: quantiles(artists, name, [*BREAKS]) for name in ("popularity", "year")}
    for name, values in breaks.items():
        if check and values[0] is not None and len(set(values)) < len(values):
            raise ValueError(f"breaks are not unique: {name} {values}")
    fixed = lambda name: F.array(*(F.lit(x).cast("double") for x in breaks[name]))
    bins = artists.select(
        "artist", "popularity", "year",
        binned(F.col("popularity"), fixed("popularity")).alias("popularity_bin"),
        binned(F.col("year"), fixed("year")).alias("year_bin"),
    )
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("NA"))
    return bins.withColumn("stratum", F.concat_ws("_", text("popularity_bin"), text("year_bin")))


def portable_hash(key: Column, seed: int = 42) -> Column:
    """0 to 999, the same in any SQL engine."""
    return (key.cast("long") * 2654435761 + seed) % 1000


def stratified_split(strata: DataFrame, train_fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """artist, stratum, is_train: of each stratum, the artists that hash lowest, floor(fraction * n) of them.

    An artist's place is the number of lower hashes, from counts, and its place among the artists of its own hash, so that no
    stratum is sorted whole."""
    hashed = strata.select("artist", "stratum", portable_hash(F.col("artist"), seed).alias("h"))
    counts = hashed.groupBy("stratum", "h").agg(F.count("*").alias("n"))
    by = W.partitionBy("stratum")  # at most 1,000 rows a stratum
    lower = counts.select(F.col("stratum").alias("s"), F.col("h").alias("k"), (F.sum("n").over(by.orderBy("h")) - F.col("n")).alias("lower"), F.sum("n").over(by).alias("all"))
    place = F.row_number().over(W.partitionBy("stratum", "h").orderBy("artist"))
    placed = hashed.withColumn("place", place).join(lower, (F.col("stratum") == F.col("s")) & F.col("h").eqNullSafe(F.col("k")))
    return placed.select("artist", "stratum", (F.col("lower") + F.col("place") <= F.floor(F.col("all") * train_fraction)).alias("is_train"))


def split_tracks(tracks: DataFrame, artists: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tracks of the training artists, and the others."""
    train = artists.where("is_train").select("artist")
    return tracks.join(train, "artist", "left_semi"), tracks.join(train, "artist", "left_anti")


def common_tags(first: DataFrame, second: DataFrame, least: int = 10) -> DataFrame:
    """Tags that at least so many artists have in either part."""
    wide = lambda df: keep_widespread(df, least).select("tag_name")
    return wide(first).intersect(wide(second))


def capped_folds(rows: DataFrame, folds: int, most: int, seed: int = 42) -> DataFrame:
    """Rows with fold: at most so many rows of each artist, lowest hashes first; an artist's rows share a fold."""
    place = F.row_number().over(W.partitionBy("artist").orderBy(portable_hash(F.col("track"), seed), "track"))
    fold = (F.col("artist").cast("long") * 2654435761 + seed) % 1000003 % folds
    return rows.withColumn("place", place).where(F.col("place") <= most).drop("place").withColumn("fold", fold)


def remap_rare(rows: DataFrame, column: str, part: str, least: int, other: str = "other") -> DataFrame:
    """Levels of column with fewer than `least` rows in some part (or none) become `other`. If that is still rare in some part,
    the smallest remaining level joins it."""

    def rare(df: DataFrame) -> DataFrame:
        parts = df.select(part).distinct()
        cells = df.select(column).distinct().crossJoin(parts).join(df.groupBy(column, part).agg(F.count("*").alias("n")), [column, part], "left")
        return cells.groupBy(column).agg(F.min(F.coalesce("n", F.lit(0))).alias("least"), F.sum("n").alias("n"))

    small = rare(rows).where(F.col("least") < least).select(F.col(column).alias("__level"))
    first = rows.join(small, F.col(column) == F.col("__level"), "left").withColumn(column, F.when(F.col("__level").isNotNull(), other).otherwise(F.col(column))).drop("__level")
    counts = rare(first)
    still = counts.where((F.col(column) == other) & (F.col("least") < least)).select(F.lit(True).alias("__still"))
    smallest = counts.where(F.col(column) != other).orderBy("n", column).limit(1).select(F.col(column).alias("__level")).crossJoin(still)
    return first.join(smallest, F.col(column) == F.col("__level"), "left").withColumn(column, F.when(F.col("__level").isNotNull(), other).otherwise(F.col(column))).drop("__level", "__still")


def distribution(rows: DataFrame, cat: str = "cat") -> DataFrame:
    """split_type, split_id, cat, n and share within the split."""
    counts = rows.groupBy("split_type", "split_id", cat).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(W.partitionBy("split_type", "split_id")))


def summary(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sample deviation, least, most and count per group."""
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(value).alias("n"))


def split_by_artist(tracks: DataFrame, train_fraction: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Strata by popularity and year, a split of the artists within them, and the tracks of both sides."""
    return split_tracks(tracks, stratified_split(artist_strata(tracks), train_fraction, seed))


def restricted(external: DataFrame, first: DataFrame, second: DataFrame, least: int = 10) -> DataFrame:
    """Rows of an external long table whose tag is common to its own rows in two sets of tracks."""
    part = lambda tracks: external.join(tracks.select("track").distinct(), "track", "left_semi")
    return external.join(common_tags(part(first), part(second), least), "tag_name", "left_semi")


def proportional_sample(rows: DataFrame, by: str, key: str, n: int, least: int = 1, seed: int = 42) -> DataFrame:
    """About n rows, as many of each group as its share (at least `least`), lowest hashes first: a sampling operator."""
    sizes = rows.groupBy(by).agg(F.count("*").alias("__n"))
    total = rows.agg(F.count("*").alias("__total"))  # one row
    quota = sizes.crossJoin(total).select(F.col(by).alias("__by"), F.greatest(F.lit(least), F.round(F.col("__n") * n / F.col("__total"))).alias("__quota"))
    place = F.row_number().over(W.partitionBy(by).orderBy(portable_hash(F.col(key), seed), key))
    return rows.withColumn("__place", place).join(quota, F.col(by).eqNullSafe(F.col("__by"))).where("__place <= __quota").select(rows.columns)


def constant_columns(rows: DataFrame, columns: list[str]) -> list[str]:
    """Columns with fewer than two different values; one pass over all of them."""
    found = rows.agg(*(F.min(c).alias(f"{k}_a") for k, c in enumerate(columns)), *(F.max(c).alias(f"{k}_b") for k, c in enumerate(columns))).first()
    return [c for k, c in enumerate(columns) if found[f"{k}_a"] == found[f"{k}_b"]]


def without_constants(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.drop(*constant_columns(rows, columns))


def repeated_folds(rows: DataFrame, folds: int, repeats: int, most: int, seed: int = 42) -> DataFrame:
    """capped_folds for several seeds, with the repeat's number."""
    out = None
    for k in range(repeats):
        one = capped_folds(rows, folds, most, seed + k).withColumn("repeat", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def split_table(folds: DataFrame, cat: str = "cat") -> DataFrame:
    """split_type, split_id, cat of folds(track, artist, fold, cat): each fold's own rows are its test part, all others its training
    part. As its users only count, `distribution` of it is a small aggregate, which Spark forms before any shuffle."""
    ids = folds.select(F.col("fold").alias("split_id")).distinct()
    return folds.crossJoin(F.broadcast(ids)).select(F.when(F.col("fold") == F.col("split_id"), "test").otherwise("train").alias("split_type"), "split_id", F.col(cat).alias("cat"))


# Checks of a tree fold


def fold_violations(mapping: DataFrame, tree: DataFrame, sizes: DataFrame, by: tuple[str, ...] = ("min_n",)) -> DataFrame:
    """by, rule, tag of all that is wrong with mapping(by, tag, cat), whose `by` ends with the least size, on the sized tour `tree` and sizes(tag, n):

    lost: a tag has no category; twice: it has several; stray: its category is neither the tag nor above it; parent: a category's parent has
    songs and is no category; small: a category other than the root holds fewer than the least size. One pass over the mapping, one over its categories."""
    folds = mapping.select(*by).distinct()
    want = folds.crossJoin(F.broadcast(sizes.select("tag")))  # a vocabulary for each fold
    n = mapping.groupBy(*by, "tag").agg(F.count("*").alias("n"))
    counted = want.join(n, [*by, "tag"], "left").select(*by, F.when(F.col("n").isNull(), "lost").when(F.col("n") > 1, "twice").alias("rule"), "tag").where("rule is not null")
    at = lambda c: tree.select(F.col("tag").alias(c), F.col("start").alias(f"{c}_start"), F.col("stop").alias(f"{c}_stop"))
    placed_ = mapping.join(at("tag"), "tag", "left").join(at("cat"), "cat", "left")
    above = (F.col("cat_start") <= F.col("tag_start")) & (F.col("tag_start") < F.col("cat_stop"))
    stray = placed_.where(~F.coalesce(above, F.col("tag") == F.col("cat"))).select(*by, F.lit("stray").alias("rule"), "tag").distinct()
    cats = mapping.join(sizes, "tag").groupBy(*by, "cat").agg(F.sum("n").alias("held"), F.count("*").alias("tags")).join(tree.select(F.col("tag").alias("cat"), "parent"), "cat")
    up = cats.select(*by, F.col("cat").alias("parent"), F.lit(True).alias("known"))
    orphan = cats.where("parent is not null").join(up, [*by, "parent"], "left").join(sizes.select(F.col("tag").alias("parent"), F.col("n").alias("own")), "parent").where("known is null and own > 0").select(*by, F.lit("parent").alias("rule"), F.col("cat").alias("tag"))
    small = cats.where((F.col("parent").isNotNull()) & (F.col("held") < F.col(by[-1])) & (F.col("held") > 0)).select(*by, F.lit("small").alias("rule"), F.col("cat").alias("tag"))
    return counted.unionByName(stray).unionByName(orphan).unionByName(small)


def broken_folds(mapping: DataFrame, by: str = "min_n") -> DataFrame:
    """Failing cases made of a good mapping(by, tag, cat), with the name of the case: without its first tag, with its first tag twice,
    with its first tag in the category of the last one, and with every tag as its own category."""
    ends = mapping.groupBy(by).agg(F.min("tag").alias("first"), F.max(F.struct("tag", "cat"))["cat"].alias("other"))
    rows = mapping.select(by, "tag", "cat").join(ends, by)
    first, named = F.col("tag") == F.col("first"), lambda df, name: df.select(F.lit(name).alias("case"), by, "tag", "cat")
    return (
        named(rows.where(~first), "lost")
        .unionByName(named(rows.unionByName(rows.where(first)), "twice"))
        .unionByName(named(rows.withColumn("cat", F.when(first, F.col("other")).otherwise(F.col("cat"))), "moved"))
        .unionByName(named(rows.withColumn("cat", F.col("tag")), "unfolded"))
    )
