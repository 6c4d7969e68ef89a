import pytest

from tagloom.operators import ingest

TAGS = "array<struct<tag_name:string,tag_count:double>>"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def nested(spark):
    data = [(1, [("a", 1.0)], [("b", 2.0)], [("c", 3.0)]), (2, [], [("b", 2.0)], [("c", 3.0)]), (3, [], None, [("c", 3.0)]), (4, None, [], []), (5, None, None, None)]
    return spark.createDataFrame(data, f"track int, track_tags {TAGS}, album_tags {TAGS}, artist_tags {TAGS}")


def test_first_set_that_holds_something(spark):
    got = {r.track: (r.tags, r.tags_source) for r in ingest.choose_tag_set(nested(spark)).collect()}
    assert [(x and [tuple(t) for t in x], s) for x, s in got.values()] == [([("a", 1.0)], "track"), ([("b", 2.0)], "album"), ([("c", 3.0)], "artist"), ([], "artist"), (None, "artist")]
    assert rows(ingest.combine_sets(nested(spark)), "track") == [(1,), (2,), (3,)]


def test_only_sets_with_tags_stay(spark):
    df = spark.createDataFrame([(1, [("a", 1.0)]), (2, []), (3, None)], f"track int, tags {TAGS}")
    assert rows(ingest.with_tags(df), "track") == [(1,)]


def test_union_of_artists(spark):
    tracks = spark.createDataFrame(
        [("t1", ["a", "unknown"]), ("t2", ["c"]), ("t3", ["a", "d"]), ("t4", ["a1", "a2"]), ("t5", ["a3"]), ("t6", []), ("t7", ["a4"])], "track string, ids array<string>"
    ).selectExpr("track", "transform(ids, i -> named_struct('id', i)) artists")
    known = [("a", ["indie", "alt"]), ("c", []), ("d", ["rock", "indie"]), ("a1", ["rock", "pop"]), ("a2", ["pop"]), ("a3", ["jazz", "blues"]), ("a4", ["x", "x"])]
    artists = spark.createDataFrame(known, "artist_id string, g array<string>").selectExpr("artist_id", "transform(g, x -> named_struct('genre', x)) genres")
    got = {r.track: [tuple(t) for t in r.tags] for r in ingest.combine_artist_tags(tracks, artists).collect()}
    assert got == {
        "t1": [("alt", 1), ("indie", 1)],
        "t3": [("alt", 1), ("indie", 2), ("rock", 1)],
        "t4": [("pop", 2), ("rock", 1)],
        "t5": [("jazz", 1), ("blues", 1)],
        "t7": [("x", 1), ("x", 1)],
    }


LONG = [(1, "A", "x"), (2, "B", "x"), (3, "B", "y"), (3, "B", "x")]


@pytest.mark.parametrize("method,want", [("artist", [1, 2, 1, 2]), ("total", [3, 3, 1, 3]), ("ones", [1, 1, 1, 1])])
def test_counts(spark, method, want):
    long = spark.createDataFrame([(*r, 9.0) for r in LONG], "track int, artist string, tag_name string, tag_count double")
    got = {(r.track, r.tag_name): r.tag_count for r in ingest.count_tags(long, method).collect()}
    assert [got[t, g] for t, _, g in LONG] == want


def test_counts_of_unknown_artists_and_methods(spark):
    long = spark.createDataFrame([(1, None, "x", 0.0), (2, None, "x", 0.0), (3, "A", None, 0.0)], "track int, artist string, tag_name string, tag_count double")
    assert rows(ingest.count_tags(long, "artist"), "track", "tag_count") == [(1, 2.0), (2, 2.0), (3, 1.0)]
    with pytest.raises(ValueError):
        ingest.count_tags(long, "mean")


def test_invalid_tags_and_unknown_ones(spark):
    long = spark.createDataFrame([("rock",), ("non-music",), ("popx",), (None,)], "tag_name string")
    assert {r.tag_name for r in ingest.drop_tags(long, ["non-music", "popx"]).collect()} == {"rock", None}


def test_unique_tags(spark):
    df = spark.createDataFrame([([], [("b", 1.0)]), ([("a", 1.0), ("b", 2.0)], []), (None, None)], f"track_tags {TAGS}, album_tags {TAGS}")
    assert rows(ingest.unique_tags(df, ("track_tags", "album_tags")), "tag_name") == [("a",), ("b",)]


def test_artist_threshold(spark):
    data = [(1, "A", "rock"), (1, "A", "pop"), (2, "B", "metal"), (3, "B", "rock"), (4, "C", "pop"), (4, "C", "jazz"), (4, "C", "blues"), (5, "D", "classical")]
    long = spark.createDataFrame(data, "track int, artist string, tag_name string")
    got = ingest.keep_widespread(long, 2)
    assert got.count() == 4 and rows(got.distinct().select("tag_name", "n_artists").distinct(), "tag_name", "n_artists") == [("pop", 2), ("rock", 2)]
    unknown = spark.createDataFrame([(1, "A", "x"), (2, None, "x")], "track int, artist string, tag_name string")
    assert ingest.keep_widespread(unknown, 2).count() == 2


def test_votes_per_track(spark):
    long = spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0), (3, 5.0), (3, None)], "track int, tag_count double")
    assert rows(ingest.keep_voted(long, 2), "track") == [(1,), (1,)]


def test_origins(spark):
    countries = spark.createDataFrame([("Wien, Austria", "Austria"), ("Lund", "Sweden"), ("France", "France")], "original string, country string")
    continents = spark.createDataFrame([("Austria", "Europe"), ("Sweden", "Europe"), ("France", "Europe"), ("Mexico", "America")], "country string, continent string")
    df = spark.createDataFrame([("Wien, Austria",), ("Paris, France",), ("Some Municipality of Oaxaca",), ("X municipality",), ("Nowhere",), (None,)], "origin string")
    rules = [("(?i)municipality of oaxaca", "Mexico"), ("(?i)municipality", "Sweden")]
    got = {r.origin: (r.country, r.continent) for r in ingest.from_origin(df, countries, continents, rules).collect()}
    assert got == {"Wien, Austria": ("Austria", "Europe"), "Paris, France": ("France", "Europe"), "Some Municipality of Oaxaca": ("Mexico", "America"), "X municipality": ("Sweden", "Europe"), "Nowhere": ("Nowhere", None), None: (None, None)}
