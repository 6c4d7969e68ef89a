"""The three ways in: records to votes, votes to a model, models to comparisons."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tagloom.operators import assign, compare, dag, fold, ingest, splits, votes


@dataclass
class Model:
    """Votes as shares, their graph, and how it folds."""

    p: DataFrame
    edges: DataFrame
    folding: fold.Folding

    def labels(self, k: int, p: DataFrame | None = None) -> DataFrame:
        """track, cat, cat_prob with k categories, of these tracks or of others with the same tags."""
        return assign.labels(self.probabilities(k, p))

    def probabilities(self, k: int, p: DataFrame | None = None) -> DataFrame:
        p = self.p if p is None else p
        return assign.probabilities(p, fold.mapping_table(p.sparkSession, self.folding, k))


def long_votes(items: DataFrame, whitelist: DataFrame, excluded: DataFrame, least: float = 2) -> DataFrame:
    """track, artist, tag_name, tag_count of nested items, valid tags only, tracks with enough votes only."""
    long = ingest.long_tags(ingest.combine_sets(items))
    valid = ingest.valid_tags(long, whitelist, excluded)
    return ingest.keep_voted(long.join(valid, "tag_name", "left_semi"), least)


def build(long: DataFrame, order: list[str] | None = None) -> Model:
    """The model of a long table (track, tag_name, tag_count)."""
    p = votes.normalized(long.withColumnsRenamed({"tag_name": "tag", "tag_count": "votes"})).persist()
    edges = dag.edges(p)
    return Model(p, edges, fold.fold(p, edges, order))


def halves(long: DataFrame, tracks: DataFrame, least: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """train, holdout, fold1 and fold2 of a long table, on the tags that both folds share."""
    train, holdout = splits.split_by_artist(tracks, 0.8, seed)
    first, second = splits.split_by_artist(train, 0.5, seed + 1)
    part = lambda t: long.join(t.select("track").distinct(), "track", "left_semi")
    tags = splits.common_tags(part(first), part(second), least)
    return {name: part(t).join(tags, "tag_name", "left_semi") for name, t in (("train", train), ("holdout", holdout), ("fold1", first), ("fold2", second))}


def robustness(first: Model, second: Model, k: int, p: DataFrame) -> dict[str, DataFrame]:
    """How far two models of the same tags agree at k categories, on the tracks of p."""
    spark = p.sparkSession
    return compare.robustness(p, *(fold.mapping_table(spark, m.folding, k) for m in (first, second)))
