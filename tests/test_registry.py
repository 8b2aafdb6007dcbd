"""
accidental removal) and every SQL-expressible one keeps its oracle."""

import __spark_entry__ as E

EXPECTED = """
read_pairs_source cap_samples dataset_slug pairs_from_turns pairs_from_messages pairs_from_columns
nonempty_pairs drop_null_pairs chat_template whitespace_tokens_docs pair_token_lengths length_quantiles
length_quantiles_by_lang recommended_length null_profile eda_summary cutoff_coverage length_histogram
pair_length_histogram seeded_shuffle_rank hash_split vocab_table encode_tokens build_sequences
supervised_tokens generated_suffix padded_batches accumulation_plan perplexity_by_run running_perplexity
train_log_intervals running_best checkpoint_retention latency_percentiles generation_throughput
variant_speedup memory_telemetry metric_log_long lcs_length rouge_l sample_scores
generation_metrics_fallback rouge_1 rouge_2 rouge_l_lib bleu_corpus evaluation_summary paired_scores
unmatched_pairs model_comparison paired_means paired_t cohens_d wilcoxon_signed_rank significance_report
metric_improvement delta_histogram score_boxplot custom_tokenizer_lengths score_with_callable
tokenizer_sequences low_rank_projection projection_parity length_quantiles_approx memory_peak
stream_turns stream_instructions fold_turns stream_fold_turns buffer_shuffle stream_buffer_shuffle stream_checkpoints
stream_retention stream_perplexity stream_metric_targets significance_report_ties rouge_bootstrap merged_quantiles
checkpoint_folders model_evaluation
""".split()
ROWS_ONLY = {"length_quantiles_approx"}


def test_all_planned_queries_registered():
    q = E.queries()
    assert sorted(set(EXPECTED) - set(q)) == []


def test_oracles_present():
    sql = E.oracle_sql()
    assert sorted(set(EXPECTED) - ROWS_ONLY - set(sql)) == []
    assert set(sql) <= set(E.queries())


def test_branches_are_reached(spark):
    """The registered parameters reach the branches that the queries exist for."""
    from paths import SF_ORACLE
    q = E.queries()
    n = spark.read.parquet(f"{SF_ORACLE}/conversations.parquet").count()
    assert 0 < q["cap_samples"](spark, SF_ORACLE).count() < n
    targets = q["supervised_tokens"](spark, SF_ORACLE)
    assert targets.where("no_target").count() > 0 and targets.where("not no_target").count() > 0
    assert q["build_sequences"](spark, SF_ORACLE).where("seq_len = 48").count() > 0
    assert q["encode_tokens"](spark, SF_ORACLE).where("n_unk > 0").count() == 0
