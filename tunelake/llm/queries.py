"""Registered queries of the corpus operators: (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from tunelake.llm import huffman_ids, piece_tokens
from tunelake.llm.bond_negatives import hard_negatives
from tunelake.llm.common import held_out, prepare, read_documents, read_labels
from tunelake.llm.katz import katz_scores
from tunelake.llm.passage_quality import quality
from tunelake.llm.quality_rules import quality_rules
from tunelake.llm.site_templates import main_text
from tunelake.llm.string_tiling import tiling
from tunelake.llm.suffix_dedup import kept_bytes, repeated_spans, with_spans
from tunelake.llm.tensor_dedup import near_duplicates
from tunelake.llm.toxicity import toxicity
from tunelake.llm.url_filter import url_filter
from tunelake.llm.whitening import whitened


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return katz_scores(read_documents(spark, sf_dir), held_out(F.col("doc_id"), 7, 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = huffman_ids.write_ids(read_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return huffman_ids.read_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op4_tensor_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return near_duplicates(read_documents(spark, sf_dir), shingle=4, num=80, den=100)


def op5_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality(read_documents(spark, sf_dir), read_labels(spark, sf_dir))


def op6_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    path = public_tokenizers.path("piece_bpe_32k.model")
    ids = piece_tokens.encode_and_decode(read_documents(spark, sf_dir), path)
    return ids.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_documents(spark, sf_dir).select("doc_id", "text")
    cut = with_spans(docs, repeated_spans(docs))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, r: acc + r["stop"] - r["start"])
    return cut.select(
        "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        F.coalesce(removed, F.lit(0)).cast("long").alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2(kept_bytes(), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return tiling(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict")


def op11_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet")
    return main_text(pages).select("page_id", "url", "text", "n_chars")


def op12_qd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return whitened(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op13_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet")
    turned = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(vectors.withColumn("label", turned), F.col("vec_id") % 100 == 0)


QUERIES = {f.__name__: f for f in (op1_katz, op2_toxicity, op3_huffman_ids, op4_tensor_dedup, op5_passage_quality, op6_piece_tokens, op7_suffix_dedup, op8_quality_rules, op9_string_tiling, op10_url_filter, op11_site_templates, op12_qd_whitening, op13_bond_negatives)}
