"""Micro-batches with dynamic padding and the accumulation plan (B1, B2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tunelake.functions.text import IGNORE_INDEX


def resolve_pad_id(pad_token_id=None, eos_token_id=None) -> int:
    """pad -> eos -> 0; a list takes its first element."""
    raw = pad_token_id if pad_token_id is not None else (eos_token_id if eos_token_id is not None else 0)
    if isinstance(raw, (list, tuple)):
        raw = raw[0]
    return int(raw)


def padded_batches(seqs: DataFrame, position: str = "position", batch_size: int = 2,
                   pad_id: int = 0, ignore_index: int = IGNORE_INDEX) -> DataFrame:
    """Consecutive examples (by ``position``) form a batch; every array is
    padded to the batch's longest member (ids with pad, mask with 0, labels
    with ignore_index).  A batch has at most ``batch_size`` rows, so the
    window per batch is bounded whatever the data size."""
    b = seqs.withColumn("batch_id", F.floor(F.col(position) / batch_size).cast("bigint"))
    mx = F.max(F.size("input_ids")).over(Window.partitionBy("batch_id"))
    b = b.withColumn("batch_max_len", mx.cast("bigint")) \
         .withColumn("_pad", (F.col("batch_max_len") - F.size("input_ids")).cast("int"))
    pad = F.col("_pad")

    def fill(col, value):
        return F.concat(F.col(col), F.array_repeat(F.lit(value).cast("bigint"), pad))
    return b.withColumn("input_ids", fill("input_ids", pad_id)) \
            .withColumn("attention_mask", fill("attention_mask", 0)) \
            .withColumn("labels", fill("labels", ignore_index)).drop("_pad")


def accumulation_plan(batches: DataFrame, n_batches: int, grad_accum: int = 8,
                      max_steps: int | None = None) -> DataFrame:
    """Which micro-batch feeds which optimizer step.

    Micro-batch ``k`` (0-based over the whole run) is batch ``k mod n_batches``
    of epoch ``k div n_batches`` (the data is re-iterated in the same order);
    step = k div grad_accum; only steps < max_steps are kept, or one epoch
    without ``max_steps``.  ``batches`` has one row per ``batch_id``.
    """
    if n_batches <= 0:
        return batches.select(F.lit(None).cast("bigint").alias("step"),
                              F.lit(None).cast("bigint").alias("micro_step"),
                              F.lit(None).cast("bigint").alias("epoch"), "batch_id").limit(0)
    needed = n_batches if max_steps is None else max_steps * grad_accum
    epochs = -(-needed // n_batches)
    e = batches.select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))).alias("epoch"))
    k = F.col("epoch") * F.lit(n_batches) + F.col("batch_id")
    return e.where(k < needed).select(
        F.floor(k / grad_accum).cast("bigint").alias("step"), (k % grad_accum).cast("bigint").alias("micro_step"),
        "epoch", *[c for c in batches.columns])
