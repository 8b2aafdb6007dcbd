"""Corpus pipeline: documents in, token ids out.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept; between stages the documents are written to the shared folder and read
back, so a lost executor costs the tasks it held and nothing more.

Cases, for every stage: a null text counts as empty; texts of any length are
read whole; null and repeated ids and repeated rows are judged by their text
(near_dedup keeps one row of equal id and text); an empty table gives an empty
one; other columns pass through whatever their names, but for the last stage,
which returns (doc_id, n_tokens, ids, text).
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.llm import piece_tokens
from tunelake.llm.common import prepare, read_documents, read_labels, release, scratch
from tunelake.llm.passage_quality import accepted
from tunelake.llm.string_tiling import decontaminated
from tunelake.llm.suffix_dedup import without_repeats
from tunelake.llm.tensor_dedup import without_near_duplicates


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier accepts."""
    prepare(spark)
    return accepted(docs, read_labels(spark, sf_dir))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8)."""
    prepare(spark)
    return without_near_duplicates(docs, shingle=5, num=80, den=100)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that a smaller document has."""
    prepare(spark)
    return without_repeats(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    prepare(spark)
    return decontaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, text) with the ids of each text and the text they decode to."""
    prepare(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_tokens.encode_and_decode(docs, path)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("tokens", tokens_stage),
]

# The classifier and the tokenizer can't be written in SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    prepare(spark)
    docs = read_documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch(stage(spark, docs, sf_dir), name)
        release(before)  # the table of the stage before; the given documents are not one
    return STAGES[-1][1](spark, docs, sf_dir)
