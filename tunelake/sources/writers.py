"""Sinks: summary JSON, Markdown reports, evaluation payload, checkpoint
metadata (S7-S11, S13).

Reports are rendered from one-row results only; data-sized outputs are
written by Spark in parallel.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def write_summary_json(summary: DataFrame, path: str) -> None:
    """One-row summary (nested structs and a map) as JSON."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(line,) for line in text.split("\n")], "value string") \
         .coalesce(1).write.mode("overwrite").text(path)


def _table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)] + [
        "| " + " | ".join(map(str, r)) + " |" for r in rows]


def _number(x, digits: int = 0) -> str:
    return "n/a" if x is None else f"{x:.{digits}f}"


def render_eda_markdown(s: Row, coverage: Row | None = None) -> str:
    """Markdown profile from the one-row ``eda_summary`` and, if given, the measured ``cutoff_coverage``."""
    parts = {"prompt": s["prompt_length_quantiles"], "response": s["response_length_quantiles"],
             "both": s["total_sequence_quantiles"]}
    lines = [f"# Profile of {s['dataset_name']}", "", f"{s['total_samples']:,} samples; "
             f"suggested length limit {s['recommended_max_seq_length']} tokens.", "", "## Missing values", ""]
    lines += _table(["column", "missing", "state"], [
        [c, n, "complete" if n == 0 else "has gaps"] for c, n in s["missing_value_counts"].items()])
    fields = [("mean", 1), ("std_dev", 1), ("p50", 0), ("p90", 0), ("p95", 0), ("p99", 0), ("max_len", 0)]
    lines += ["", "## Tokens per sample", ""]
    lines += _table(["part", *[f for f, _ in fields]], [
        [name, *[_number(q[f], d) for f, d in fields]] for name, q in parts.items()])
    if coverage is not None:
        lines += ["", f"{_number(100 * (coverage['coverage'] or 0.0), 2)} % of {coverage['n']:,} samples fit into "
                  f"{coverage['cutoff']} tokens."]
    return "\n".join([*lines, ""])


def render_significance_markdown(rep: Row, alpha: float) -> str:
    """Markdown of one significance-report row."""
    verdict = "better" if rep["is_statistically_significant"] else "no proven gain"
    lines = [f"# Paired comparison: {verdict} (level {alpha})", ""]
    lines += _table(["mean of base", "mean of fused", "difference"], [
        [f"{rep['base_mean']:.4f}", f"{rep['fused_mean']:.4f}", f"{rep['mean_delta']:+.4f}"]])
    lines += ["", *_table(["test", "statistic", "p"], [
        ["t (paired)", f"{rep['t_statistic']:.4f}", f"{rep['t_test_p_value']:.3e}"],
        ["signed rank", f"{rep['wilcoxon_statistic']:.1f}", f"{rep['wilcoxon_p_value']:.3e}"]])]
    return "\n".join([*lines, "", f"Effect size d = {rep['cohens_d']:.4f}.", ""])


def significance_payload(report: DataFrame, base_name: str, fused_name: str,
                         base_metrics: DataFrame | None = None, fused_metrics: DataFrame | None = None) -> DataFrame:
    """Nested JSON-ready row: model names, aggregate metric maps (one-row frames with a map
    column ``metrics``) and the test result struct (one row per comparison)."""
    test_cols = [c for c in report.columns if c not in ("status", "n", "wilcoxon_method")]
    out = report.select(F.struct(F.lit(base_name).alias("base"), F.lit(fused_name).alias("fused")).alias("models"),
                        F.struct(*test_cols).alias("statistical_hypothesis_test"))
    for name, metrics in (("base", base_metrics), ("fused", fused_metrics)):
        m = metrics.select(F.col("metrics").alias(f"_{name}")) if metrics is not None else None
        out = out.withColumn(f"_{name}", F.lit(None).cast("map<string,double>")) if m is None else out.crossJoin(m)
    return out.withColumn("aggregate_metrics", F.struct(F.col("_base").alias("base"), F.col("_fused").alias("fused"))
                          ).drop("_base", "_fused")


def evaluation_payload(scores: DataFrame, base_name: str, fused_name: str, base_results: dict,
                       fused_results: dict, with_vectors: bool = False) -> DataFrame:
    """The evaluation payload (names, metric maps, both score vectors) as one row.

    The vectors are left empty, as the long form written by ``write_scores_long``
    has the scores; ``with_vectors=True`` puts all of them into the one record, for
    evaluation sets that fit into it.
    """
    if not with_vectors:
        scores = scores.limit(0)

    def mp(d):
        return F.create_map(*[x for k, v in d.items() for x in (F.lit(k), F.lit(float(v)))]) if d \
            else F.create_map().cast("map<string,double>")
    return scores.agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "base"))), lambda x: x["base"]).alias("scores_base"),
        F.transform(F.array_sort(F.collect_list(F.struct("sample_id", "fused"))), lambda x: x["fused"]).alias("scores_fused")) \
        .select(F.lit(base_name).alias("base_model"), F.lit(fused_name).alias("fused_model"),
                mp(base_results).alias("base_results"), mp(fused_results).alias("fused_results"),
                "scores_base", "scores_fused")


def write_scores_long(scores: DataFrame, path: str) -> None:
    """Scale-out form of the score vectors: (sample_id, base, fused) parquet."""
    scores.write.mode("overwrite").parquet(path)


def write_trainer_states(states: DataFrame, root: str) -> None:
    """Checkpoint metadata rows (step, epoch, metrics, is_best, best value,
    extra state) as one table under ``root``, which ``read_trainer_states`` reads."""
    states.write.mode("overwrite").parquet(f"{root}/trainer_states.parquet")
