"""From nested item records to the long vote table (track, artist, tag, tag_count).

Nested tag sets are array<struct<tag_name, tag_count>>; null and empty both mean that there are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tagloom.sources import sizes

SET_COLUMNS = ("track_tags", "album_tags", "artist_tags")


def has_tags(tags: str) -> Column:
    return F.coalesce(F.size(tags) > 0, F.lit(False))


def choose_tag_set(df: DataFrame, to: str = "tags", sets: Iterable[str] = SET_COLUMNS) -> DataFrame:
    """The first set that isn't empty, and which one it was (the last if all are empty)."""
    *first, last = sets
    chosen, source = None, None
    for name in first:
        label = name.removesuffix("_tags")
        chosen = F.when(has_tags(name), F.col(name)) if chosen is None else chosen.when(has_tags(name), F.col(name))
        source = F.when(has_tags(name), label) if source is None else source.when(has_tags(name), label)
    return df.withColumns({to: chosen.otherwise(F.col(last)), f"{to}_source": source.otherwise(last.removesuffix("_tags"))})


def with_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    """Rows whose tag set holds something."""
    return df.where(has_tags(tags))


def combine_sets(df: DataFrame) -> DataFrame:
    """Best available tag set of each item; items without any go."""
    return with_tags(choose_tag_set(df))


def combine_artist_tags(tracks: DataFrame, artists: DataFrame, partitions: int | None = None) -> DataFrame:
    """Union of the genres of all artists of a track, as a tag set.

    tracks: track, artists array<struct<id>>; artists: artist_id, genres array<struct<genre>> (of repeated ids the first by
    genres counts). One artist: the genres in their order, each 1. Several (known or not): counted, in alphabetical order.
    Tracks in partitions by track stay there; partitions: of the shuffles, if there are too many artists to broadcast.
    """
    known = artists.groupBy("artist_id").agg(F.min("genres").alias("genres"))
    single = F.size("artists") == 1
    members = tracks.select("track", single.alias("single"), F.posexplode("artists").alias("a", "artist")).select("track", "single", F.col("artist.id").alias("id"))
    size = known.count()
    met = sizes.looked_up(members, "id", known, "artist_id", partitions, size)
    if partitions is not None and size > sizes.MOST_LOOKUP:
        met = met.repartition(partitions, "track")
    genres = met.select("track", "single", F.posexplode("genres").alias("pos", "g"))
    counted = genres.groupBy("track", "single", F.col("g.genre").alias("tag_name"), F.when(F.col("single"), F.col("pos")).alias("pos")).agg(F.count("*").cast("double").alias("tag_count"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "tag_name", "tag_count")))
    return counted.groupBy("track").agg(F.transform(ordered, lambda x: F.struct(x.tag_name.alias("tag_name"), x.tag_count.alias("tag_count"))).alias("tags"))


def unpack_tags(df: DataFrame, tags: str = "tags") -> DataFrame:
    """One row per tag of each item."""
    return df.select(*[c for c in df.columns if c != tags], F.inline(tags))


def count_tags(long: DataFrame, method: str) -> DataFrame:
    """Replace tag_count: by rows per (tag, artist), rows per tag, or one."""
    if method == "ones":
        return long.withColumn("tag_count", F.lit(1).cast("double"))
    keys = {"artist": ["tag_name", "artist"], "total": ["tag_name"]}.get(method)
    if keys is None:
        raise ValueError("method must be artist, total or ones")
    # counts are joined back so that a frequent tag isn't gathered in one window; nulls meet nulls
    counts = long.groupBy(*keys).agg(F.count("*").cast("double").alias("n")).select(*(F.col(k).alias(f"__{k}") for k in keys), "n")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return long.join(counts, same).withColumn("tag_count", F.col("n")).select(long.columns)


def long_tags(df: DataFrame, tags: str = "tags", method: str | None = None) -> DataFrame:
    """Nested items to the long table; counts are the sets' own, or by a method."""
    long = unpack_tags(with_tags(df, tags), tags)
    return long if method is None else count_tags(long, method)


def drop_tags(long: DataFrame, tags: list[str]) -> DataFrame:
    """Rows whose tag isn't in the list; a null tag isn't in any."""
    return long.where(F.coalesce(~F.col("tag_name").isin(tags), F.lit(True)))


def valid_tags(tags: DataFrame, whitelist: DataFrame, excluded: DataFrame) -> DataFrame:
    """Distinct tags on the whitelist and not among the excluded."""
    return tags.select("tag_name").distinct().join(whitelist, "tag_name", "left_semi").join(excluded, "tag_name", "left_anti")


def unique_tags(df: DataFrame, sets: Iterable[str] = SET_COLUMNS) -> DataFrame:
    """Distinct tag names over several nested columns."""
    every = F.concat(*(F.coalesce(F.transform(c, lambda x: x["tag_name"]), F.array().cast("array<string>")) for c in sets))
    return df.select(F.explode(every).alias("tag_name")).distinct()


def keep_voted(long: DataFrame, least: float) -> DataFrame:
    """Rows of tracks with at least so many votes; a track with an unknown count has an unknown total and goes.

    Whole tracks go, so what stays is unchanged and one pass is enough."""
    total = F.when(F.count("tag_count") == F.count("*"), F.sum("tag_count"))
    voted = long.groupBy("track").agg(total.alias("total")).where(F.col("total") >= least)
    return long.join(voted.select("track"), "track", "left_semi")


def keep_widespread(long: DataFrame, least: int) -> DataFrame:
    """Rows of tags that at least so many artists have, with n_artists; an unknown artist counts as one."""
    n = F.countDistinct("artist") + F.max(F.col("artist").isNull().cast("int"))
    wide = long.groupBy("tag_name").agg(n.cast("long").alias("n_artists")).where(F.col("n_artists") >= least)
    return long.join(wide, "tag_name")


def select_columns(raw: DataFrame, scalars: list[str], prefix: str) -> DataFrame:
    """Named columns, those that start with a prefix, and the derived ones of nested columns (null if there are none)."""
    chosen = [*scalars, *(c for c in raw.columns if c.startswith(prefix) and c not in scalars)]
    styles = F.array_join("album_styles", "; ")
    genres = F.array_join(F.transform("album_genres", lambda g: g["name"]), "; ")
    first = F.get("album_genres", F.lit(0)).getField("name")
    return raw.select(
        *chosen,
        F.array_join(F.transform("artists", lambda a: a["id"]), ";").alias("track_artist_ids"),
        F.size("artists").alias("n_track_artists"),
        F.when(F.size("album_styles") > 0, styles).alias("album_style_text"),
        F.when(F.size("album_genres") > 0, genres).alias("album_genre_text"),
        F.when(F.size("album_genres") > 0, F.concat(first, F.lit("; "), genres)).alias("album_first_genre_text"),
    )


def split_rows(df: DataFrame, column: str, sep: str = "; ") -> DataFrame:
    """One row per part of a delimited string."""
    return df.withColumn(column, F.explode(F.split(column, sep)))


def drop_always_alone(p: DataFrame) -> DataFrame:
    """Rows of tags that share a track at least once."""
    alone = p.groupBy("tag").agg(F.min("p").alias("least")).where("least >= 1").select("tag")
    return p.join(alone, "tag", "left_anti")


def union_all(*frames: DataFrame) -> DataFrame:
    """Rows of all, by column name; missing columns are null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def from_origin(df: DataFrame, countries: DataFrame, continents: DataFrame, rules: list[tuple[str, str]] = ()) -> DataFrame:
    """country and continent of a free-text origin: the lookup of the whole text, else its last comma part, else the first rule
    (pattern, country) that matches."""
    last = F.trim(F.regexp_extract("origin", "([^,]+)$", 1))
    ruled = F.lit(None).cast("string")
    for pattern, country in reversed(rules):
        ruled = F.when(F.col("origin").rlike(pattern), country).otherwise(ruled)
    whole = countries.select(F.col("original").alias("origin"), F.col("country").alias("c1"))
    part = countries.select(F.col("original").alias("part"), F.col("country").alias("c2"))
    found = df.withColumn("part", last).join(whole, "origin", "left").join(part, "part", "left")
    named = found.withColumn("country", F.coalesce("c1", "c2", ruled, "part")).drop("part", "c1", "c2")
    return named.join(continents, "country", "left")


def matching(df: DataFrame, pattern: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, then those whose name matches a pattern."""
    return df.select(*keep, *(c for c in df.columns if c not in keep and re.search(pattern, c)))


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """All columns but the kept ones renamed with a prefix."""
    return df.withColumnsRenamed({c: f"{prefix}{c}" for c in df.columns if c not in keep})


def moved_first(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*columns, *(c for c in df.columns if c not in columns))


def long_scores(df: DataFrame, keys: list[str], columns: list[str], prefix: str = "") -> DataFrame:
    """Score columns as rows (tag_name, tag_count), names less their prefix; unknown scores go."""
    long = df.select(*keys, *columns).unpivot(keys, columns, "tag_name", "tag_count")
    return long.withColumn("tag_name", F.regexp_replace("tag_name", f"^{re.escape(prefix)}", "")).where("tag_count is not null")
