"""The pipeline against the plain versions of its stages, on the smallest tables."""

import zlib
from array import array

import corpus_pipeline
from tagloom.llm import mil_classifier, tokens
from tests.llm.test_native import BLANK
from tests.llm.test_similar import plain_kept
from tests.llm.test_substring_dedup import brute

D = "/root/testdata/sf0.001"


def test_rows_of_the_whole_run(spark):
    docs, labels = (spark.read.parquet(f"{D}/{t}.parquet") for t in ("documents", "labels"))
    model = mil_classifier.train(docs, labels)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    scores = mil_classifier.scores_of(model, [t.encode() for _, t in rows])
    rows = [r for r, s in zip(rows, scores, strict=True) if s >= mil_classifier.THRESHOLD]
    best = {}
    for d, t in rows:
        best.setdefault(BLANK.sub("", t), []).append((-len(t), d))
    rows = [(d, t) for d, t in rows if min(best[BLANK.sub("", t)])[1] == d]
    kept = plain_kept(rows)
    assert len(kept) < len(rows)
    rows = [r for k, r in enumerate(rows) if k in kept]
    library = tokens.load(tokens.tokenizer_path("byte_bpe_50k.json"))
    texts = [t if not gone else left for (_, t), (_, gone, left) in zip(rows, brute([t for _, t in rows]), strict=True)]
    want = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for (d, _), t in zip(rows, texts, strict=True)}
    pieces = corpus_pipeline.run(spark, D).collect()
    assert {p.doc_id for p in pieces} == set(want)
    for p in pieces:
        assert p.ids_crc32 == zlib.crc32(array("I", want[p.doc_id][p.start : p.start + p.length]).tobytes())
    assert sum(p.length for p in pieces) == sum(map(len, want.values()))


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, D).columns == docs.columns
    assert corpus_pipeline.ORACLE_SQL is None


def test_stages_on_awkward_rows(spark, awkward, tmp_path):
    """Nulls, clashing and dotted names, repeated rows; every stage gives rows with the columns it got."""
    awkward.write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    for _, stage in corpus_pipeline.STAGES[1:-1]:
        out = stage(spark, docs, D)
        assert out.columns == docs.columns and 0 < out.count() <= docs.count()
    kept = mil_classifier.drop_low_quality(docs, spark.read.parquet(f"{D}/labels.parquet"))
    assert kept.columns == docs.columns and kept.count() <= docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, D).count() >= docs.count()


def test_stages_on_no_rows(spark, nothing):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, D).count() == 0
