"""Loss accumulation and perplexity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.operators.segmented import running_aggregates

# Fixed value: the exponent cap of the perplexity.
PPL_EXP_CAP = 100.0


def valid_loss(loss: Column) -> Column:
    """Finite losses only: NaN, +-Inf and null are ignored, as by the tracker."""
    return loss.isNotNull() & ~F.isnan(loss) & (F.abs(loss) < F.lit(float("inf")))


def mean_loss(total_loss: Column, total_tokens: Column) -> Column:
    """Token-weighted mean; 0.0 when no token was seen."""
    return F.when(F.coalesce(total_tokens, F.lit(0)) == 0, F.lit(0.0)) \
            .otherwise(F.try_divide(total_loss.cast("double"), total_tokens.cast("double")))


def perplexity(loss: Column) -> Column:
    """exp(min(loss, 100)); 1.0 for a mean loss <= 0; null for null and NaN."""
    return F.when(loss.isNull() | F.isnan(loss), F.lit(None).cast("double")) \
            .when(loss <= 0.0, F.lit(1.0)).otherwise(F.exp(F.least(loss, F.lit(PPL_EXP_CAP))))


def perplexity_by_group(log: DataFrame, group: list[str], loss: str = "loss",
                        tokens: str = "num_tokens") -> DataFrame:
    """(group..., steps, total_tokens, mean_loss, perplexity); invalid losses are
    skipped but their group still appears (with 0 steps -> loss 0, ppl 1)."""
    ok = valid_loss(F.col(loss))
    agg = log.groupBy(*group).agg(
        F.sum(F.when(ok, F.col(loss) * F.col(tokens))).alias("_tl"),
        F.sum(F.when(ok, F.col(tokens))).alias("_tt"),
        F.count_if(ok).cast("bigint").alias("steps"))
    ml = mean_loss(F.col("_tl"), F.col("_tt"))
    return agg.select(*group, "steps", F.coalesce(F.col("_tt"), F.lit(0)).cast("bigint").alias("total_tokens"),
                      ml.alias("mean_loss"), perplexity(ml).alias("perplexity"))


def running_perplexity(log: DataFrame, group: list[str], order: list[str], loss: str = "loss",
                       tokens: str = "num_tokens", ordinal: str | None = None) -> DataFrame:
    """Mean loss and perplexity as read after every update, per group; ``ordinal`` names a column for the
    number of the update, counted in the same pass."""
    ok = valid_loss(F.col(loss))
    r = running_aggregates(log, group, order, {
        **({ordinal: ("count", F.lit(1), True)} if ordinal else {}),
        "_rl": ("sum", F.when(ok, F.col(loss) * F.col(tokens)), True),
        "_rt": ("sum", F.when(ok, F.col(tokens)), True),
        "valid_steps": ("count", F.when(ok, F.lit(1)), True)})
    ml = mean_loss(F.col("_rl"), F.col("_rt"))
    return r.withColumn("running_loss", ml).withColumn("running_perplexity", perplexity(ml)) \
            .drop("_rl", "_rt")


def train_log_intervals(log: DataFrame, run: str = "run", step: str = "step", ts: str = "ts",
                        loss: str = "loss", logging_steps: int = 10, grad_accum: int = 8,
                        batch_size: int = 2) -> DataFrame:
    """The training log line of every ``logging_steps`` steps and of the last step.

    ``loss_ref`` reproduces the printed value: the step loss is a sum over the
    micro-batches (grad_accum x the mean) and the window sum is divided by
    ``logging_steps`` even for a short last window.  ``loss_mean`` is the plain
    mean step loss.  Throughput is cumulative samples per second since the
    run's first step.  All work is partially aggregated group-bys.
    """
    n = logging_steps
    interval = F.ceil(F.col(step) / F.lit(n)).cast("bigint")
    iv = log.groupBy(run, interval.alias("interval")).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_steps"),
        F.sum(F.col(loss) * F.lit(grad_accum)).alias("_sum_ref"),
        F.avg(F.col(loss)).alias("loss_mean"),
        F.max(ts).alias("_ts_end"))
    runs = log.groupBy(run).agg(F.max(step).alias("_last_step"), F.min(ts).alias("_ts_start"))
    j = iv.join(runs, on=run, how="inner")
    log_step = F.least(F.col("interval") * F.lit(n), F.col("_last_step")).cast("bigint")
    elapsed = (F.unix_micros(F.col("_ts_end").cast("timestamp"))
               - F.unix_micros(F.col("_ts_start").cast("timestamp"))) / F.lit(1e6)
    return j.select(run, "interval", log_step.alias("log_step"), "n_steps",
                    (F.col("_sum_ref") / F.lit(float(n))).alias("loss_ref"), "loss_mean",
                    F.try_divide(log_step * F.lit(batch_size * grad_accum), elapsed).alias("samples_per_sec"))
