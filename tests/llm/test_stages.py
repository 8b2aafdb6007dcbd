"""Every stage on tables with odd columns and rows; the whole pipeline against its stages."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from helpers import empty, odd_documents

SMALL = "/root/testdata/sf0.001"
CLASHING = ["spans", "_id", "_slot", "_crc", "_key", "_gone", "_gone_key", "_found", "_contaminated", "_passage_score", "_others",
            "key", "first", "cls", "root", "a", "b", "digest", "n_shingles", "kept", "score", "crc", "label", "item_id", "ids", "a.b"]


def clashing(docs):
    return docs.select("doc_id", "text", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])


@pytest.mark.parametrize("name, stage", C.STAGES[:-1])
def test_columns_of_any_name(spark, name, stage):
    docs, rows = odd_documents(spark)
    plain = stage(spark, docs.select("doc_id", "text"), SMALL)
    got = stage(spark, clashing(docs), SMALL)
    assert got.columns == ["doc_id", "text", *CLASHING]
    kept = got.collect()
    assert all(tuple(r)[2:] == tuple(range(len(CLASHING))) for r in kept)
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id is not None and r.text is not None) == sorted(
        (r.doc_id, r.text) for r in plain.collect() if r.doc_id is not None and r.text is not None)
    assert len(kept) == plain.count()


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_empty_table(spark, name, stage):
    docs = empty(spark)
    got = stage(spark, docs, SMALL)
    assert got.collect() == []
    if name != "tokens":
        assert got.columns == docs.columns


def test_null_columns(spark):
    docs = spark.createDataFrame([(1, "some words here", None), (None, None, None), (2, None, 3)], "doc_id long, text string, n_chars long")
    for name, stage in C.STAGES:
        assert stage(spark, docs, SMALL).count() <= 3
    assert C.STAGES[1][1](spark, docs, SMALL).count() == 3


def test_tokens_stage(spark):
    import public_tokenizers
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    docs, rows = odd_documents(spark)
    got = C.STAGES[-1][1](spark, docs, SMALL)
    assert got.columns == ["doc_id", "n_tokens", "ids", "text"]
    want = [(d, library.encode(t or "") + [2]) for d, t in rows]
    assert sorted(((r.doc_id, r.ids, r.n_tokens, r.text) for r in got.collect()), key=str) == sorted(
        ((d, i, len(i), library.decode(i)) for d, i in want), key=str)


def test_run_is_its_stages(spark):
    """run() is the stages one after another on what the one before kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for name, stage in C.STAGES:
        docs = spark.createDataFrame(stage(spark, docs, SMALL).collect(), stage(spark, docs, SMALL).schema)
    got = C.run(spark, SMALL)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, docs.collect())) and got.count() > 50
