"""Instruction pairs -> token ids -> masked training sequences -> batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.functions.text import DEFAULT_PROMPT_TEMPLATE, whitespace_tokens
from tunelake.operators.batching import padded_batches
from tunelake.operators.pairs import chat_template
from tunelake.operators.scoring import tokenizer_ids
from tunelake.operators.sequences import build_sequences
from tunelake.operators.splits import seeded_shuffle
from tunelake.operators.vocab import encode_columns


def encoded_pairs(pairs: DataFrame, id_col: str = "conv_id", vocab_size: int | None = None,
                  template: str = DEFAULT_PROMPT_TEMPLATE, tokens_fn=whitespace_tokens,
                  vocab: DataFrame | None = None, tokenizer=None) -> DataFrame:
    """(id, prompt_ids, response_ids) of the templated pair.

    With ``tokenizer`` (a factory of ``text -> ids``) the ids come from it, in
    one Arrow pass without vocabulary, shuffle or join.  Otherwise a given
    vocabulary is used, or one of all tokens of the same templated texts.
    """
    if tokenizer is not None:
        f = chat_template(pairs, template)
        return f.select(id_col, tokenizer_ids(F.col("formatted_prompt"), tokenizer).alias("prompt_ids"),
                        tokenizer_ids(F.col("formatted_response"), tokenizer).alias("response_ids"))
    f = chat_template(pairs, template).select(
        id_col, tokens_fn("formatted_prompt").alias("pt"), tokens_fn("formatted_response").alias("rt"))
    return encode_columns(f, id_col, {"prompt": F.col("pt"), "response": F.col("rt")}, vocab, vocab_size)


def training_sequences(pairs: DataFrame, id_col: str = "conv_id", max_len: int = 2048,
                       vocab_size: int | None = None, **kw) -> DataFrame:
    return build_sequences(encoded_pairs(pairs, id_col, vocab_size, **kw), max_len=max_len)


def training_batches(pairs: DataFrame, id_col: str = "conv_id", batch_size: int = 2,
                     max_len: int = 2048, seed: int = 42, pad_id: int = 0, **kw) -> DataFrame:
    """Sequences in the seeded shuffle order, grouped and padded per batch."""
    seqs = training_sequences(pairs, id_col, max_len, **kw)
    ordered = seeded_shuffle(seqs, id_col, seed)
    return padded_batches(ordered, "position", batch_size, pad_id)
