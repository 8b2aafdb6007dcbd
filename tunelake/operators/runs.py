"""Checkpoint bookkeeping and run telemetry roll-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunelake.operators.order_stats import exact_quantiles
from tunelake.operators.segmented import previous_value, row_ordinal, running_aggregates

INF = float("inf")


def running_best(ckpts: DataFrame, run: str = "run", step: str = "step", metrics: str = "metrics",
                 metric_name: str = "eval_loss", mode: str = "min", order: list[str] | None = None,
                 ordinal: str | None = None) -> DataFrame:
    """Per checkpoint: is it strictly better than every earlier one, and the
    best value after it.  A missing or NaN metric is never best and leaves the
    best unchanged; the initial best is +inf (min) / -inf (max).

    Checkpoints come in ``order`` (default: the step); ``ordinal`` names a column
    for their number within the run, counted in the same pass."""
    mode = mode.lower()
    if mode not in ("min", "max"):
        raise ValueError(f"mode must be min or max, not {mode!r}")
    m = F.try_element_at(F.col(metrics), F.lit(metric_name))
    clean = F.when(F.isnan(m), F.lit(None)).otherwise(m)
    base = ckpts.withColumn("metric", m).withColumn("_clean", clean)
    r = running_aggregates(base, [run], order or [step], {
        "_prev": (mode, F.col("_clean"), False), **({ordinal: ("count", F.lit(1), True)} if ordinal else {})})
    start = F.lit(INF if mode == "min" else -INF)
    prev = F.coalesce(F.col("_prev"), start)
    better = (F.col("_clean") < prev) if mode == "min" else (F.col("_clean") > prev)
    best = F.when(F.coalesce(better, F.lit(False)), F.col("_clean")).otherwise(prev)
    return r.withColumn("is_best", F.coalesce(better, F.lit(False))) \
            .withColumn("best_metric_value", best).drop("_prev", "_clean")


def checkpoint_retention(best: DataFrame, run: str = "run", step: str = "step",
                         max_to_keep: int = 3, ordinal: str | None = None) -> DataFrame:
    """Keep/purge plan: the newest ``max_to_keep`` checkpoint folders of a run
    stay (save order is step order); the last checkpoint marked best is also
    kept as the best copy.  Nothing is deleted here.

    ``ordinal`` names the number of the checkpoint within its run, if ``best`` has it
    (``running_best`` counts it); else it is counted here.  Counts and last best of
    the runs are one row for each run, joined back.
    """
    at = ordinal or "_at"
    rows = best if ordinal else row_ordinal(best, [run], [step], at)
    of_run = rows.groupBy(F.col(run).alias("_run")).agg(
        F.max(at).alias("_n"), F.max(F.when(F.col("is_best"), F.col(at))).alias("_last_best"))
    r = rows.join(of_run, F.col(run).eqNullSafe(F.col("_run")))
    kept = F.col("recency") <= max_to_keep
    best_copy = F.coalesce(F.col(at) == F.col("_last_best"), F.lit(False))
    return r.withColumn("recency", F.col("_n") - F.col(at) + 1).withColumn("kept", kept).withColumn("best_copy", best_copy) \
            .withColumn("action", F.when(kept | best_copy, F.lit("keep")).otherwise(F.lit("purge"))) \
            .drop("_run", "_n", "_last_best", "_at")


def skip_warmup(log: DataFrame, group: str, seq: str, warmup: int = 2) -> DataFrame:
    return log.where(F.col(seq) > warmup)


def skip_first(log: DataFrame, group: str, order: list[str], warmup: int = 2) -> DataFrame:
    """``skip_warmup`` for a log without a sequence number: drops the first ``warmup`` rows of each group in
    ``order`` (unique).  The last of them is found by a window with a rank limit, which keeps that many
    rows of a group in each task; no group is sorted or numbered."""
    if warmup <= 0:
        return log
    at = F.struct(*order)
    first = Window.partitionBy(group).orderBy(*order)
    last = (log.select(group, *order).withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= warmup)
            .groupBy(F.col(group).alias("_group")).agg(F.max(at).alias("_last")))
    return log.join(last, F.col(group).eqNullSafe(F.col("_group"))).where(at > F.col("_last")).drop("_group", "_last")


def latency_percentiles(log: DataFrame, variant: str = "variant", elapsed: str = "elapsed_ms",
                        peak: str = "peak_mb") -> DataFrame:
    """mean / p50 / p90 / p99 (linear interpolation) latency and peak memory.

    Latencies are continuous, so the percentiles come from counts of key
    ranges (``order_stats``) rather than a per-value counter map; the other
    figures are algebraic aggregates."""
    q = exact_quantiles(log, elapsed, (0.5, 0.9, 0.99), [variant],
                        ["p50_latency_ms", "p90_latency_ms", "p99_latency_ms"])
    a = log.groupBy(variant).agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 F.avg(elapsed).alias("mean_latency_ms"), F.max(peak).alias("peak_vram_mb"))
    return a.join(q, on=variant, how="inner").select(
        variant, "n", "mean_latency_ms", "p50_latency_ms", "p90_latency_ms", "p99_latency_ms", "peak_vram_mb")


def generation_throughput(log: DataFrame, variant: str = "variant", tokens: str = "tokens",
                          seconds: str = "seconds") -> DataFrame:
    """Tokens, seconds, tokens/s and ms/token per variant, zero-guarded and rounded
    like the reference result (4 / 2 / 2 decimals)."""
    g = log.groupBy(variant).agg(F.count(F.lit(1)).cast("bigint").alias("total_samples"),
                                 F.sum(tokens).cast("bigint").alias("total_tokens_generated"),
                                 F.sum(seconds).alias("_sec"))
    tok, sec = F.col("total_tokens_generated").cast("double"), F.col("_sec")
    return g.select(variant, "total_samples", "total_tokens_generated",
                    F.round(sec, 4).alias("total_latency_seconds"),
                    F.round(F.when(tok > 0, sec / tok * 1000.0).otherwise(0.0), 2).alias("latency_per_token_ms"),
                    F.round(F.when(sec > 0, tok / sec).otherwise(0.0), 2).alias("tokens_per_second"))


def variant_speedup(stats: DataFrame, a: str, b: str, variant: str = "variant") -> DataFrame:
    """speed-up = mean_a / max(mean_b, 1e-6); memory saved = peak_a - peak_b."""
    one = stats.agg(
        F.max(F.when(F.col(variant) == a, F.col("mean_latency_ms"))).alias("_ma"),
        F.max(F.when(F.col(variant) == b, F.col("mean_latency_ms"))).alias("_mb"),
        F.max(F.when(F.col(variant) == a, F.col("peak_vram_mb"))).alias("_pa"),
        F.max(F.when(F.col(variant) == b, F.col("peak_vram_mb"))).alias("_pb"))
    return one.select(F.lit(a).alias("variant_a"), F.lit(b).alias("variant_b"),
                      (F.col("_ma") / F.greatest(F.col("_mb"), F.lit(1e-6))).alias("speedup_factor"),
                      (F.col("_pa") - F.col("_pb")).alias("vram_saved_mb"))


def memory_telemetry(log: DataFrame, device: str = "device", order=("ts", "event_id")) -> DataFrame:
    """Per sample: GB figures at 3 decimals, free = total - reserved,
    fragmentation % = (reserved - allocated) / (reserved + 1e-6) * 100 at 2
    decimals, and the reserved memory freed since the previous sample of the
    same device (skew-safe lag: one device may hold most samples)."""
    r = log.select(device, *order,
                   F.round("allocated", 3).alias("allocated_gb"), F.round("reserved", 3).alias("reserved_gb"),
                   F.round("max_allocated", 3).alias("max_allocated_gb"),
                   F.round(F.col("total") - F.col("reserved"), 3).alias("free_gb"),
                   F.round("total", 3).alias("total_gb"))
    r = r.withColumn("fragmentation_pct", F.round(
        (F.col("reserved_gb") - F.col("allocated_gb")) / (F.col("reserved_gb") + F.lit(1e-6)) * 100.0, 2))
    r = previous_value(r, [device], list(order), "reserved_gb", "_prev_reserved")
    return r.withColumn("freed_gb", F.round(F.col("_prev_reserved") - F.col("reserved_gb"), 3)) \
            .drop("_prev_reserved")
