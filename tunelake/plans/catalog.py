"""Registered queries: name -> f(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (or inputs Spark derives from them) in
full.  Array results are projected to strings with ``array_join`` and every
computed column is aliased, so they compare 1:1 with ``oracle.SQL``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.functions.text import whitespace_tokens
from tunelake.operators import pairs as P
from tunelake.operators import profile as A
from tunelake.operators import sketches as K
from tunelake.operators import splits as S
from tunelake.plans import derived as D
from tunelake.session import work_folder
from tunelake.sources import checkpoint_folders as CF
from tunelake.sources import readers as R
from tunelake.sources.tables import load_table

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# Fewer than the conversations of any test table, so that the cap cuts.
MAX_SAMPLES = 50


def _t(spark, sf_dir, name):
    return load_table(spark, sf_dir, name)


# -- sources ---------------------------------------------------------------

@query
def read_pairs_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.read_pairs_source(spark, f"{sf_dir}/conversations.parquet", schema=R.TURNS_SCHEMA)


@query
def cap_samples(spark, sf_dir):
    return R.cap_samples(_t(spark, sf_dir, "conversations"), max_samples=MAX_SAMPLES)


@query
def dataset_slug(spark, sf_dir):
    return _t(spark, sf_dir, "pages").select("page_id", R.dataset_slug(F.col("url")).alias("slug"))


# -- pairs -----------------------------------------------------------------

@query
def pairs_from_turns(spark, sf_dir):
    return D.pairs_raw(spark, sf_dir)


@query
def pairs_from_messages(spark, sf_dir):
    folded = P.fold_messages(_t(spark, sf_dir, "conversations"))
    return P.pairs_from_messages(folded)


@query
def pairs_from_columns(spark, sf_dir):
    flat = _t(spark, sf_dir, "documents").select(
        "doc_id", F.col("text").alias("instruction"), F.col("source").alias("output"))
    return P.pairs_from_columns(flat, keep=["doc_id"])


@query
def nonempty_pairs(spark, sf_dir):
    return D.pairs(spark, sf_dir)


@query
def drop_null_pairs(spark, sf_dir):
    return P.drop_null_pairs(D.pairs_raw(spark, sf_dir))


@query
def chat_template(spark, sf_dir):
    return P.chat_template(D.pairs(spark, sf_dir)).select(
        "conv_id", "formatted_prompt", "formatted_response")


# -- tokens and profiling ----------------------------------------------------

@query
def whitespace_tokens_docs(spark, sf_dir):
    t = whitespace_tokens("text")
    return _t(spark, sf_dir, "documents").select(
        "doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, " ").alias("tokens"))


@query
def pair_token_lengths(spark, sf_dir):
    return A.with_token_lengths(D.pairs(spark, sf_dir)).select(
        "conv_id", "prompt_tokens", "response_tokens", "total_tokens")


@query
def length_quantiles(spark, sf_dir):
    return A.length_quantiles(A.with_token_lengths(D.pairs(spark, sf_dir)))


@query
def length_quantiles_by_lang(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(
        "lang", F.size(whitespace_tokens("text")).cast("bigint").alias("doc_tokens"))
    return A.length_quantiles(docs, measures=("doc_tokens",), group_by=["lang"])


@query
def recommended_length(spark, sf_dir):
    s = A.length_quantiles(A.with_token_lengths(D.pairs(spark, sf_dir)),
                           measures=("total_tokens",))
    return s.select(F.col("p99").alias("total_p99"),
                    A.recommended_length(F.col("p99")).alias("recommended_max_seq_length"))


@query
def null_profile(spark, sf_dir):
    return A.null_profile(D.pairs_raw(spark, sf_dir))


@query
def eda_summary(spark, sf_dir):
    return A.flatten_summary(A.eda_summary(D.pairs_raw(spark, sf_dir), "conversations"))


@query
def cutoff_coverage(spark, sf_dir):
    return A.cutoff_coverage(A.with_token_lengths(D.pairs(spark, sf_dir)))


@query
def length_histogram(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(
        F.size(whitespace_tokens("text")).alias("doc_tokens"))
    return A.histogram(docs, "doc_tokens", 60)


@query
def pair_length_histogram(spark, sf_dir):
    lens = A.with_token_lengths(D.pairs(spark, sf_dir))
    long = lens.select(F.explode(F.array(
        F.struct(F.lit("prompt").alias("measure"), F.col("prompt_tokens").alias("n")),
        F.struct(F.lit("response").alias("measure"), F.col("response_tokens").alias("n")))).alias("r")) \
        .select("r.*")
    return A.histogram(long, "n", 50, group_by=["measure"])


# -- shuffles and splits -----------------------------------------------------

@query
def seeded_shuffle_rank(spark, sf_dir):
    return S.seeded_shuffle(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query
def hash_split(spark, sf_dir):
    return S.hash_split(_t(spark, sf_dir, "documents").select("doc_id"), "doc_id")


# -- vocabulary, sequences, batches ----------------------------------------

from tunelake.operators import batching as B  # noqa: E402
from tunelake.operators import sequences as Q  # noqa: E402
from tunelake.operators import vocab as V  # noqa: E402
from tunelake.plans import training_data as TD  # noqa: E402

# Shorter than many pairs of the test tables, so that sequences are cut and targets lost.
MAX_SEQ_LEN = 48
BATCH_SIZE = 2
GRAD_ACCUM = 8
MAX_STEPS = 1000


def _ids_str(c):
    return F.array_join(F.col(c).cast("array<string>"), " ")


@query
def vocab_table(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select(whitespace_tokens("text").alias("t"))
    return V.vocab_table(docs, "t")


@query
def encode_tokens(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents").select("doc_id", whitespace_tokens("text").alias("t"))
    enc = V.encode_columns(docs, "doc_id", {"text": F.col("t")})
    return enc.select("doc_id", F.size("text_ids").cast("bigint").alias("n_tokens"),
                      F.size(F.filter("text_ids", lambda x: x == V.UNK_ID)).cast("bigint").alias("n_unk"),
                      _ids_str("text_ids").alias("ids"))


@query
def build_sequences(spark, sf_dir):
    s = TD.training_sequences(D.pairs(spark, sf_dir), max_len=MAX_SEQ_LEN)
    return s.select("conv_id", F.size("prompt_ids").cast("bigint").alias("prompt_len"),
                    F.size("input_ids").cast("bigint").alias("seq_len"),
                    _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"),
                    _ids_str("attention_mask").alias("attention_mask"))


@query
def tokenizer_sequences(spark, sf_dir):
    s = TD.training_sequences(D.pairs(spark, sf_dir), max_len=MAX_SEQ_LEN,
                              tokenizer=lambda: lambda text: [len(w) + 2 for w in text.split()])
    return s.select("conv_id", F.size("prompt_ids").cast("bigint").alias("prompt_len"),
                    F.size("input_ids").cast("bigint").alias("seq_len"),
                    _ids_str("input_ids").alias("input_ids"), _ids_str("labels").alias("labels"))


@query
def supervised_tokens(spark, sf_dir):
    s = TD.training_sequences(D.pairs(spark, sf_dir), max_len=MAX_SEQ_LEN)
    n = Q.supervised_tokens(F.col("labels"))
    return s.select("conv_id", n.alias("supervised_tokens"), (n == 0).alias("no_target"))


@query
def generated_suffix(spark, sf_dir):
    e = TD.encoded_pairs(D.pairs(spark, sf_dir))
    out = F.concat("prompt_ids", "response_ids")
    suf = Q.generated_suffix(F.col("prompt_ids"), out)
    return e.select("conv_id", (F.size(out) - F.size("prompt_ids")).cast("bigint").alias("generated_count"),
                    F.array_join(suf.cast("array<string>"), " ").alias("generated_ids"))


@query
def padded_batches(spark, sf_dir):
    b = TD.training_batches(D.pairs(spark, sf_dir), batch_size=BATCH_SIZE, max_len=MAX_SEQ_LEN)
    return b.select("conv_id", "position", "batch_id", "batch_max_len", _ids_str("input_ids").alias("input_ids"),
                    _ids_str("attention_mask").alias("attention_mask"), _ids_str("labels").alias("labels"))


@query
def accumulation_plan(spark, sf_dir):
    pairs = D.pairs(spark, sf_dir)
    order = S.seeded_shuffle(pairs.select("conv_id"), "conv_id")
    batches = order.groupBy(F.floor(F.col("position") / BATCH_SIZE).cast("bigint").alias("batch_id")) \
                   .agg(F.count(F.lit(1)).cast("bigint").alias("batch_rows"))
    last = order.agg(F.max("position")).first()[0]  # scalar, from the written order: the pairs are read once
    return B.accumulation_plan(batches, 0 if last is None else last // BATCH_SIZE + 1, GRAD_ACCUM, MAX_STEPS)


# -- losses and runs ---------------------------------------------------------

from tunelake.operators import losses as L  # noqa: E402
from tunelake.operators import runs as RU  # noqa: E402

LOGGING_STEPS = 10
MAX_TO_KEEP = 3
WARMUP_STEPS = 2


@query
def perplexity_by_run(spark, sf_dir):
    return L.perplexity_by_group(D.loss_log(spark, sf_dir), ["run"])


@query
def running_perplexity(spark, sf_dir):
    r = L.running_perplexity(D.loss_events(spark, sf_dir), ["run"], ["ts", "event_id"], ordinal="step")
    return r.select("run", "step", "valid_steps", "running_loss", "running_perplexity")


@query
def train_log_intervals(spark, sf_dir):
    return L.train_log_intervals(D.loss_log(spark, sf_dir), logging_steps=LOGGING_STEPS,
                                 grad_accum=GRAD_ACCUM, batch_size=BATCH_SIZE)


@query
def running_best(spark, sf_dir):
    return RU.running_best(D.ckpt_events(spark, sf_dir), order=["ts", "event_id"], ordinal="step").select(
        "run", "step", "metric", "is_best", "best_metric_value")


@query
def checkpoint_retention(spark, sf_dir):
    b = RU.running_best(D.ckpt_events(spark, sf_dir), order=["ts", "event_id"], ordinal="step")
    return RU.checkpoint_retention(b, max_to_keep=MAX_TO_KEEP, ordinal="step").select(
        "run", "step", "is_best", "recency", "kept", "best_copy", "action")


def _latency_stats(spark, sf_dir):
    log = RU.skip_first(D.latency_events(spark, sf_dir), "variant", ["ts", "event_id"], WARMUP_STEPS)
    return RU.latency_percentiles(log)


@query
def latency_percentiles(spark, sf_dir):
    return _latency_stats(spark, sf_dir)


@query
def generation_throughput(spark, sf_dir):
    return RU.generation_throughput(D.gen_log(spark, sf_dir))


@query
def variant_speedup(spark, sf_dir):
    return RU.variant_speedup(_latency_stats(spark, sf_dir), "click", "view")


@query
def memory_telemetry(spark, sf_dir):
    return RU.memory_telemetry(D.memory_log(spark, sf_dir)).select(
        "device", "event_id", "allocated_gb", "reserved_gb", "free_gb", "fragmentation_pct", "freed_gb")


@query
def metric_log_long(spark, sf_dir):
    ll = D.loss_log(spark, sf_dir)
    m = F.create_map(F.lit("train/loss"), F.col("loss"),
                     F.lit("train/num_tokens"), F.col("num_tokens").cast("double"),
                     F.lit("train/ppl"), L.perplexity(F.col("loss")))
    return ll.select("run", "step", F.explode(m).alias("key", "value")).where(F.col("value").isNotNull())


# -- text metrics ------------------------------------------------------------

from tunelake.operators import textmetrics as TM  # noqa: E402


BOOTSTRAP = 200


def _eval_pairs(spark, sf_dir):
    """Evaluation view of the pairs: the response plays the prediction and the
    prompt the reference (deterministic, data-derived)."""
    return D.pairs(spark, sf_dir).select("conv_id", F.col("response").alias("prediction"),
                                         F.col("prompt").alias("reference"))


@query
def lcs_length(spark, sf_dir):
    return TM.with_rouge_l(_eval_pairs(spark, sf_dir)).select("conv_id", "pred_len", "ref_len", "lcs")


@query
def rouge_l(spark, sf_dir):
    return TM.with_rouge_l(_eval_pairs(spark, sf_dir)).select("conv_id", "lcs", "rouge_l")


@query
def sample_scores(spark, sf_dir):
    s = TM.with_rouge_l(_eval_pairs(spark, sf_dir))
    return s.select("conv_id", TM.sample_score(F.col("rouge_l")).alias("score"))


@query
def generation_metrics_fallback(spark, sf_dir):
    return TM.generation_metrics_fallback(TM.with_rouge_l(_eval_pairs(spark, sf_dir)))


@query
def rouge_1(spark, sf_dir):
    return TM.rouge_n(_eval_pairs(spark, sf_dir), "conv_id", orders=(1,)).select(
        "conv_id", "overlap_1", "pred_1grams", "ref_1grams", "rouge1")


@query
def rouge_2(spark, sf_dir):
    return TM.rouge_n(_eval_pairs(spark, sf_dir), "conv_id", orders=(2,)).select(
        "conv_id", "overlap_2", "pred_2grams", "ref_2grams", "rouge2")


@query
def rouge_l_lib(spark, sf_dir):
    return TM.rouge_l_lib(_eval_pairs(spark, sf_dir)).select("conv_id", "lib_lcs", "lib_rouge_l")


@query
def bleu_corpus(spark, sf_dir):
    return TM.bleu_corpus(_eval_pairs(spark, sf_dir), "conv_id")


@query
def evaluation_summary(spark, sf_dir):
    """One row: library-mode ROUGE-1/2/L and BLEU of the evaluation pairs, and
    the token-weighted perplexity of the whole loss log."""
    # Three metric branches read the pairs: write them once instead of
    # re-shuffling every conversation turn three times.
    from tunelake.session import cut_lineage
    ev = cut_lineage(_eval_pairs(spark, sf_dir))
    rn = TM.rouge_n(ev, "conv_id", orders=(1, 2)).agg(F.avg("rouge1").alias("r1"), F.avg("rouge2").alias("r2"))
    rl = TM.rouge_l_lib(ev).agg(F.avg("lib_rouge_l").alias("rl"))
    bl = TM.bleu_corpus(ev, "conv_id").select("bleu")
    pp = L.perplexity_by_group(D.loss_log(spark, sf_dir), []).select("perplexity")
    return _one_row(rn, rl, bl, pp)


def _one_row(*frames):
    """Combine one-row aggregates without a join: each becomes (name, value)
    rows, the rows are unioned, and one conditional aggregation pivots them
    back into a single row."""
    long = None
    for f in frames:
        part = f.select(F.explode(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("double").alias("v"))
                                            for c in f.columns])).alias("r")).select("r.*")
        long = part if long is None else long.unionByName(part)

    def pick(name):
        return F.max(F.when(F.col("k") == name, F.col("v")))
    return long.agg(F.round(pick("r1") * 100.0, 4).alias("rouge1"),
                    F.round(pick("r2") * 100.0, 4).alias("rouge2"),
                    F.round(pick("rl") * 100.0, 4).alias("rougeL"),
                    F.round(pick("bleu") * 100.0, 4).alias("bleu"),
                    F.round(pick("perplexity"), 4).alias("perplexity"))


# Words that the two stand-in models generate.
MODELS = {"base": 4, "fused": 12}


@query
def model_evaluation(spark, sf_dir):
    """Every pair scored once by each of two models; the library metrics of the generated texts and the
    perplexity of the references under the model."""
    from tunelake.plans.jobs import evaluate_model
    items = D.pairs(spark, sf_dir).select(F.col("conv_id").alias("sample_id"), "prompt", F.col("response").alias("reference"))
    rows = []
    for name, words in MODELS.items():
        _, m = evaluate_model(items, lambda words=words: SC.echo_model(words), work_folder(spark, f"scored-{name}"), library=True)
        rows.append((name, m["rouge1"], m["rouge2"], m["rougeL"], m["bleu"], m["perplexity"]))
    return spark.createDataFrame(rows, "variant string, rouge1 double, rouge2 double, rougeL double, bleu double, perplexity double")


@query
def rouge_bootstrap(spark, sf_dir):
    """The interval of the library mode, by a Poisson bootstrap."""
    ev = _eval_pairs(spark, sf_dir)
    scores = TM.rouge_n(TM.rouge_l_lib(ev), "conv_id", orders=(1, 2), keep=("lib_rouge_l",)).select(
        "conv_id", "rouge1", "rouge2", F.col("lib_rouge_l").alias("rougeL"))
    b = TM.bootstrap_interval(scores, "conv_id", ["rouge1", "rouge2", "rougeL"], BOOTSTRAP)
    return b.select("metric", *[F.round(F.col(c) * 100.0, 4).alias(c) for c in ("low", "mid", "high")])


# -- paired tests --------------------------------------------------------------

from tunelake.operators import hypothesis as H  # noqa: E402

ALPHA = 0.01


def _variant_scores(spark, sf_dir):
    """Long scores: odd steps of a run score the base model, even steps the
    fused one; sample_id pairs step 2k-1 with 2k."""
    ll = D.loss_log(spark, sf_dir)
    return ll.select(F.col("run").alias("group_id"),
                     F.floor((F.col("step") + 1) / 2).cast("bigint").alias("sample_id"),
                     F.when(F.col("step") % 2 == 1, F.lit("base")).otherwise(F.lit("fused")).alias("variant"),
                     F.col("loss").alias("score"))


@query
def paired_scores(spark, sf_dir):
    p = H.variant_pairs(_variant_scores(spark, sf_dir), ["group_id", "sample_id"])
    return p.where("n_base > 0 and n_fused > 0").select(
        "group_id", "sample_id", "base", "fused", (F.col("fused") - F.col("base")).alias("delta"))


@query
def unmatched_pairs(spark, sf_dir):
    return H.unmatched_variants(H.variant_pairs(_variant_scores(spark, sf_dir), ["group_id", "sample_id"]), ["group_id"])


@query
def model_comparison(spark, sf_dir):
    return H.model_comparison(_variant_scores(spark, sf_dir), ["group_id"])


@query
def paired_means(spark, sf_dir):
    return H.paired_summary(D.paired(spark, sf_dir), ["group_id"]).select(
        "group_id", "n", "base_mean", "fused_mean", "mean_delta")


@query
def paired_t(spark, sf_dir):
    return H.paired_summary(D.paired(spark, sf_dir), ["group_id"]).select("group_id", "n", "t_statistic")


@query
def cohens_d(spark, sf_dir):
    return H.paired_summary(D.paired(spark, sf_dir), ["group_id"]).select("group_id", "cohens_d")


@query
def wilcoxon_signed_rank(spark, sf_dir):
    return H.wilcoxon_stats(D.paired(spark, sf_dir), ["group_id"]).select(
        "group_id", "n_nonzero", "r_plus", "r_minus", "w_statistic", "tie_term")


@query
def significance_report(spark, sf_dir):
    """H6 without the three rounded means (``paired_means`` has them unrounded)."""
    r = H.significance_report(D.paired(spark, sf_dir), ["group_id"], alpha=ALPHA)
    return r.withColumns({c: F.round(c, 6) for c in ("t_test_p_value", "wilcoxon_p_value")}) \
            .drop("base_mean", "fused_mean", "mean_delta")


@query
def significance_report_ties(spark, sf_dir):
    """H4 over whole scores, which tie: the exact distribution of the mid-ranks."""
    p = D.paired(spark, sf_dir).select("group_id", "sample_id", F.floor("base").cast("double").alias("base"),
                                       F.floor("fused").cast("double").alias("fused"))
    r = H.significance_report(p, ["group_id"], alpha=ALPHA, method="exact")
    return r.select("group_id", "n", "wilcoxon_statistic", F.round("wilcoxon_p_value", 6).alias("wilcoxon_p_value"),
                    "wilcoxon_method")


@query
def metric_improvement(spark, sf_dir):
    return H.metric_improvement(D.paired(spark, sf_dir), ["group_id"])


@query
def delta_histogram(spark, sf_dir):
    return H.delta_histogram(D.paired(spark, sf_dir), 15)


@query
def score_boxplot(spark, sf_dir):
    p = D.paired(spark, sf_dir)
    long = p.select(F.explode(F.array(F.struct(F.lit("base").alias("variant"), F.col("base").alias("score")),
                                      F.struct(F.lit("fused").alias("variant"), F.col("fused").alias("score"))))
                    .alias("r")).select("r.*")
    return H.score_boxplot(long)


# -- model application ---------------------------------------------------------

from tunelake.operators import scoring as SC  # noqa: E402

# Rule-defined weights of one linear layer with a rank-8 adapter (alpha 16)
# on the 64-dim embeddings: M[i][j] = ((a*i + b*j) mod m - shift) / scale.
EMB_DIM, RANK, ALPHA_LORA = 64, 8, 16
W_RULE, A_RULE, B_RULE = (7, 3, 11, 5, 50.0), (5, 11, 13, 6, 40.0), (3, 7, 9, 4, 30.0)


def _weights():
    return (SC.rule_matrix(EMB_DIM, EMB_DIM, *W_RULE), SC.rule_matrix(RANK, EMB_DIM, *A_RULE),
            SC.rule_matrix(EMB_DIM, RANK, *B_RULE))


def _projection(spark, sf_dir):
    W, A, B = _weights()
    return SC.low_rank_projection(_t(spark, sf_dir, "embeddings"), "embedding", ["vec_id"], W, A, B,
                                  RANK, ALPHA_LORA)


@query
def custom_tokenizer_lengths(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return docs.select("doc_id", SC.tokenizer_lengths(F.col("text"), SC.word_punct_tokenizer).alias("n_tokens"))


@query
def score_with_callable(spark, sf_dir):
    ev = _eval_pairs(spark, sf_dir).select("conv_id", F.col("reference").alias("prompt"),
                                          F.col("prediction").alias("reference"))
    return SC.score_with_model(ev, lambda: SC.echo_model(10 ** 9), keep=["conv_id"])


@query
def low_rank_projection(spark, sf_dir):
    p = _projection(spark, sf_dir)
    return p.select("vec_id", F.posexplode(F.arrays_zip("fused", "two_step")).alias("i", "z")) \
            .select("vec_id", F.col("i").cast("bigint").alias("i"),
                    F.round("z.fused", 6).alias("fused"), F.round("z.two_step", 6).alias("two_step"))


@query
def projection_parity(spark, sf_dir):
    p = SC.projection_parity(_projection(spark, sf_dir), ["vec_id"])
    return p.select("vec_id", F.round("max_abs_diff", 6).alias("max_abs_diff"), "parity_ok")


# -- additions: approximate quantiles, memory peak -----------------------------

@query
def length_quantiles_approx(spark, sf_dir):
    """The bounded-memory sketch variant on document token counts (rows-only:
    an approximate result has no exact oracle; its rank error is unit-tested)."""
    docs = _t(spark, sf_dir, "documents").select(
        "lang", F.size(whitespace_tokens("text")).cast("bigint").alias("doc_tokens"))
    return A.length_quantiles(docs, measures=("doc_tokens",), group_by=["lang"], approx=True)


@query
def merged_quantiles(spark, sf_dir):
    """A2b, mergeable: sketches stored by language and source, merged by language; each merged quantile
    with whether its exact rank keeps the error bound."""
    docs = _t(spark, sf_dir, "documents").select(
        "lang", "source", F.size(whitespace_tokens("text")).cast("bigint").alias("doc_tokens"))
    table = work_folder(spark, "sketches")
    K.build_sketches(docs, "doc_tokens", ["lang", "source"]).write.parquet(table)
    merged = K.merge_sketches(spark.read.parquet(table), ["lang"])
    errors = K.rank_errors(K.sketch_quantiles(merged, A.QUANTILES, ["lang"]), docs, "doc_tokens", ["lang"])
    return errors.select("lang", "q", "n", (F.col("rank_error") <= K.RANK_ERROR).alias("within_bound"))


@query
def checkpoint_folders(spark, sf_dir):
    """The checkpoints that retention keeps, written as folders and read back."""
    best = RU.running_best(D.ckpt_events(spark, sf_dir), order=["ts", "event_id"], ordinal="step")
    kept = RU.checkpoint_retention(best, max_to_keep=MAX_TO_KEEP, ordinal="step").where("kept or best_copy")
    root = work_folder(spark, "checkpoint-folders")
    CF.write_checkpoint_folders(kept.select(
        F.col("event_id").cast("bigint").alias("step"), F.col("step").cast("bigint").alias("epoch"), "metrics", "is_best",
        "best_metric_value", F.create_map(F.lit("run"), F.col("run").cast("string")).alias("extra_state")), root)
    s = R.read_trainer_states(spark, root)
    return s.select("step", "epoch", F.col("metrics")["eval_loss"].alias("eval_loss"), "is_best", "best_metric_value",
                    F.col("extra_state")["run"].alias("run"))


@query
def memory_peak(spark, sf_dir):
    """R4 summary per device: peak allocation, peak reservation, worst fragmentation."""
    t = RU.memory_telemetry(D.memory_log(spark, sf_dir))
    return t.groupBy("device").agg(F.count(F.lit(1)).cast("bigint").alias("samples"),
                                   F.max("max_allocated_gb").alias("peak_allocated_gb"),
                                   F.max("reserved_gb").alias("peak_reserved_gb"),
                                   F.max("fragmentation_pct").alias("max_fragmentation_pct"))


# -- streams -------------------------------------------------------------------

from tunelake.plans import stream_queries  # noqa: E402,F401
