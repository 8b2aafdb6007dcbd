"""
dataset profiling, model evaluation, significance testing, and the
training-data path.  Each is a short composition of the library functions;
all data-sized work runs on Spark, only one-row results reach the driver.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tunelake.functions.text import DEFAULT_PROMPT_TEMPLATE, whitespace_tokens
from tunelake.operators import batching as B
from tunelake.operators import hypothesis as H
from tunelake.operators import losses as L
from tunelake.operators import pairs as P
from tunelake.operators import profile as A
from tunelake.operators import scoring as SC
from tunelake.operators import textmetrics as TM
from tunelake.operators.segmented import first_n
from tunelake.plans.training_data import training_batches
from tunelake.sources import readers as R
from tunelake.sources import writers as W


def _slug(spark: SparkSession, name: str) -> str:
    return spark.range(1).select(R.dataset_slug(F.lit(name)).alias("s")).first().s


def normalize_pairs(raw: DataFrame, prompt_col: str = "prompt", response_col: str = "response",
                    id_col: str | None = None) -> DataFrame:
    """Any supported sample layout -> (id, prompt, response).

    The layout is decided once from the schema, with the reference's
    precedence: a ``messages`` array wins; a one-row-per-turn table
    (conv_id, turn, role, text) is folded; otherwise flat columns with the
    instruction/output aliases."""
    cols = raw.columns
    if "messages" in cols:
        keep = [id_col] if id_col else []
        df = raw if id_col else raw.withColumn("sample_id", F.monotonically_increasing_id())
        return P.pairs_from_messages(df.select(*(keep or ["sample_id"]), "messages"), chunk_col=None)
    if {"conv_id", "turn", "role", "text"} <= set(cols):
        return P.pairs_from_turns(raw)
    df = raw if id_col else raw.withColumn("sample_id", F.monotonically_increasing_id())
    return P.pairs_from_columns(df, prompt_col, response_col, keep=[id_col or "sample_id"])


def run_eda_job(spark: SparkSession, source: str, output_dir: str, dataset_name: str | None = None,
                max_samples: int | None = None, prompt_col: str = "prompt", response_col: str = "response",
                tokens_fn=whitespace_tokens, split: str | None = None) -> Row:
    """Profile an instruction dataset and write the JSON summary, the Markdown
    report and the histogram tables.  Returns the one-row summary."""
    raw = R.read_pairs_source(spark, source, split=split)
    if {"conv_id", "turn", "role", "text"} <= set(raw.columns):
        pairs = normalize_pairs(raw if max_samples is None else R.cap_samples(raw, max_samples))
    else:
        pairs = normalize_pairs(raw, prompt_col, response_col)
        if max_samples is not None:  # first N samples in id order
            idc = pairs.columns[0]
            pairs = pairs.join(first_n(pairs.select(idc).distinct(), [idc], max_samples), idc, "left_semi")
    pairs = P.nonempty_pairs(pairs)
    if pairs.limit(1).count() == 0:
        raise ValueError(f"{source} holds no sample with both a prompt and a response")
    name = dataset_name or _slug(spark, source)
    summary = A.eda_summary(pairs.select("prompt", "response"), name, tokens_fn=tokens_fn)
    row = summary.first()
    W.write_summary_json(spark.createDataFrame([row], summary.schema), f"{output_dir}/{name}_eda_summary.json")
    # Lengths are written once; the coverage and both histograms read them.
    A.with_token_lengths(pairs, tokens_fn=tokens_fn).select(
        pairs.columns[0], "prompt_tokens", "response_tokens", "total_tokens").write.mode("overwrite").parquet(
        f"{output_dir}/{name}_lengths.parquet")
    lens = spark.read.parquet(f"{output_dir}/{name}_lengths.parquet")
    W.write_text(spark, W.render_eda_markdown(row, A.cutoff_coverage(lens).first()),
                 f"{output_dir}/{name}_eda_report.md")
    A.histogram(lens, "total_tokens", 60).write.mode("overwrite").parquet(
        f"{output_dir}/{name}_total_histogram.parquet")
    long = lens.select(F.explode(F.array(
        F.struct(F.lit("prompt").alias("measure"), F.col("prompt_tokens").alias("n")),
        F.struct(F.lit("response").alias("measure"), F.col("response_tokens").alias("n")))).alias("r")).select("r.*")
    A.histogram(long, "n", 50, group_by=["measure"]).write.mode("overwrite").parquet(
        f"{output_dir}/{name}_prompt_response_histogram.parquet")
    return row


def evaluate_model(items: DataFrame, model_factory, path: str, library: bool = False) -> tuple[DataFrame, dict]:
    """Score every evaluation item with one model, once.

    The per-sample table (sample_id, prediction, reference, loss, num_tokens,
    rouge_l, score) is written to ``path``; the metrics (ROUGE-1/2/L and BLEU
    of the library mode, or the fallback mode, and the perplexity) are computed
    from what was written.
    """
    scored = SC.score_with_model(items.select("sample_id", "prompt", "reference"), model_factory,
                                 keep=["sample_id", "reference"])
    TM.with_rouge_l(scored, "prediction", "reference").withColumn(
        "score", TM.sample_score(F.col("rouge_l"))).write.mode("overwrite").parquet(path)
    per = items.sparkSession.read.parquet(path)
    if library:
        n = TM.rouge_n(per, "sample_id", "prediction", "reference").agg(
            F.avg("rouge1").alias("rouge1"), F.avg("rouge2").alias("rouge2")).first()
        long = TM.rouge_l_lib(per, "prediction", "reference").agg(F.avg("lib_rouge_l").alias("r")).first()["r"]
        bleu = TM.bleu_corpus(per, "sample_id", "prediction", "reference").first()["bleu"]
        metrics = {k: round(100.0 * (v or 0.0), 4) for k, v in (
            ("rouge1", n["rouge1"]), ("rouge2", n["rouge2"]), ("rougeL", long), ("bleu", bleu))}
    else:
        metrics = TM.generation_metrics_fallback(per, "prediction", "reference").first().asDict()
    ppl = L.perplexity_by_group(per.withColumnRenamed("num_tokens", "tok"), [], "loss", "tok").first()
    return per, {**metrics, "perplexity": round(ppl["perplexity"], 4)}


def run_evaluation_job(spark: SparkSession, test_path: str, output_dir: str, base_factory, fused_factory,
                       base_name: str = "base", fused_name: str = "fused", allow_default: bool = False,
                       library: bool = False, with_vectors: bool = True) -> DataFrame:
    """Evaluate two models on the same items and write the payload (names,
    metric maps, score vectors) and the long score table."""
    R.read_eval_items(spark, test_path, allow_default=allow_default).write.mode("overwrite").parquet(
        f"{output_dir}/items.parquet")
    items = spark.read.parquet(f"{output_dir}/items.parquet")
    b_per, b_metrics = evaluate_model(items, base_factory, f"{output_dir}/scored_base.parquet", library)
    f_per, f_metrics = evaluate_model(items, fused_factory, f"{output_dir}/scored_fused.parquet", library)
    scores = b_per.select("sample_id", F.col("score").alias("base")).join(
        f_per.select("sample_id", F.col("score").alias("fused")), "sample_id", "full_outer")
    W.write_scores_long(scores, f"{output_dir}/scores_long.parquet")
    scores = spark.read.parquet(f"{output_dir}/scores_long.parquet")
    payload = W.evaluation_payload(scores, base_name, fused_name, b_metrics, f_metrics, with_vectors)
    W.write_summary_json(payload, f"{output_dir}/raw_evaluation_vectors.json")
    return payload


def run_significance_job(spark: SparkSession, eval_file: str, output_dir: str, alpha: float = 0.01) -> Row:
    """Paired tests on a score-vector payload; writes the JSON report, the
    Markdown table and the two chart tables (box plot, delta histogram)."""
    vectors = R.read_score_vectors(spark, eval_file)
    H.check_paired(vectors)
    report = H.significance_report(vectors, [], alpha=alpha)
    row = report.first()
    raw = spark.read.option("multiLine", True).schema(R.SCORE_PAYLOAD_SCHEMA).json(eval_file)
    names = raw.select("base_model", "fused_model").first()
    W.write_summary_json(
        W.significance_payload(spark.createDataFrame([row], report.schema), names["base_model"] or "baseline",
                               names["fused_model"] or "fused",
                               raw.select(F.col("base_results").alias("metrics")),
                               raw.select(F.col("fused_results").alias("metrics"))),
        f"{output_dir}/statistical_significance_report.json")
    W.write_text(spark, W.render_significance_markdown(row, alpha), f"{output_dir}/summary_table.md")
    long = vectors.select(F.explode(F.array(F.struct(F.lit("base").alias("variant"), F.col("base").alias("score")),
                                            F.struct(F.lit("fused").alias("variant"), F.col("fused").alias("score"))))
                          .alias("r")).select("r.*")
    H.score_boxplot(long).write.mode("overwrite").parquet(f"{output_dir}/boxplot.parquet")
    H.delta_histogram(vectors, 15).write.mode("overwrite").parquet(f"{output_dir}/delta_histogram.parquet")
    return row


def run_training_data_job(spark: SparkSession, source: str, output_dir: str, batch_size: int = 2,
                          max_seq_length: int = 2048, grad_accum: int = 8, max_steps: int | None = None,
                          seed: int = 42, vocab_size: int | None = None, template: str = DEFAULT_PROMPT_TEMPLATE,
                          pad_token_id=None, eos_token_id=None) -> DataFrame:
    """Instruction source -> padded micro-batches and the accumulation plan,
    both written as parquet.  Returns the batches DataFrame (lazy)."""
    pairs = P.nonempty_pairs(normalize_pairs(R.read_pairs_source(spark, source)))
    idc = pairs.columns[0]
    pad = B.resolve_pad_id(pad_token_id, eos_token_id)
    batches = training_batches(pairs, idc, batch_size, max_seq_length, seed, pad,
                               vocab_size=vocab_size, template=template)
    batches.write.mode("overwrite").parquet(f"{output_dir}/batches.parquet")
    written = spark.read.parquet(f"{output_dir}/batches.parquet")
    per_batch = written.groupBy("batch_id").agg(F.count(F.lit(1)).cast("bigint").alias("batch_rows"))
    n_batches = per_batch.count()
    B.accumulation_plan(per_batch, n_batches, grad_accum, max_steps).write.mode("overwrite").parquet(
        f"{output_dir}/accumulation_plan.parquet")
    return written
