"""Training sequences: concatenate, truncate, mask, attention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.text import IGNORE_INDEX


def input_ids(prompt_ids: Column, response_ids: Column, max_len: int) -> Column:
    """``(prompt + response)[:max_len]`` -- the response tail is cut first."""
    return F.slice(F.concat(prompt_ids, response_ids), 1, max_len)


def masked_labels(prompt_ids: Column, ids: Column, max_len: int,
                  ignore_index: int = IGNORE_INDEX) -> Column:
    """-100 over the prompt part, the ids afterwards; all -100 when the prompt
    fills the window.  One expression covers both branches of the rule."""
    n_mask = F.least(F.size(prompt_ids), F.size(ids))
    return F.concat(F.array_repeat(F.lit(ignore_index).cast("bigint"), n_mask),
                    F.slice(ids, F.size(prompt_ids) + 1, F.lit(max_len)))


def attention_mask(ids: Column) -> Column:
    return F.array_repeat(F.lit(1).cast("bigint"), F.size(ids))


def build_sequences(df: DataFrame, prompt_ids: str = "prompt_ids", response_ids: str = "response_ids",
                    max_len: int = 2048, ignore_index: int = IGNORE_INDEX) -> DataFrame:
    """Adds input_ids, labels, attention_mask (array<bigint>, equal lengths)."""
    ids = input_ids(F.col(prompt_ids), F.col(response_ids), max_len)
    return df.withColumn("input_ids", ids) \
             .withColumn("labels", masked_labels(F.col(prompt_ids), F.col("input_ids"), max_len, ignore_index)) \
             .withColumn("attention_mask", attention_mask(F.col("input_ids")))


def supervised_tokens(labels: Column, ignore_index: int = IGNORE_INDEX) -> Column:
    """Number of positions that carry a target (label != ignore_index)."""
    return F.size(F.filter(labels, lambda x: x != F.lit(ignore_index))).cast("bigint")


def generated_suffix(input_ids_col: Column, output_ids_col: Column) -> Column:
    """``output[len(input):]`` -- the generated part of a generation output."""
    n = F.greatest(F.size(output_ids_col) - F.size(input_ids_col), F.lit(0))
    return F.slice(output_ids_col, F.size(input_ids_col) + 1, n)
