"""Instruction samples -> (prompt, response) pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.functions.text import (DEFAULT_PROMPT_TEMPLATE, RESPONSE_SUFFIX,
                                     append_suffix, render_template)


def _last_content(messages: str, role: str):
    return F.try_element_at(
        F.transform(F.filter(F.col(messages), lambda m: m["role"] == F.lit(role)),
                    lambda m: m["content"]), F.lit(-1))


def fold_messages(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                  role_col: str = "role", text_col: str = "text",
                  chunk_turns: int = 256) -> DataFrame:
    """One-row-per-turn table -> chat form ``messages array<struct<role,content>>``.

    A conversation is folded in chunks of at most ``chunk_turns`` turns
    (column ``chunk``), so no single group, however long the conversation,
    is collected into one array.  ``pairs_from_messages`` merges chunks.
    """
    msg = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
                   F.col(text_col).alias("content"))
    return (turns.groupBy(id_col, F.floor(F.col(turn_col) / chunk_turns).alias("chunk"))
                 .agg(F.array_sort(F.collect_list(msg)).alias("_m"))
                 .select(id_col, "chunk",
                         F.transform("_m", lambda m: F.struct(m["role"].alias("role"),
                                                              m["content"].alias("content")))
                         .alias("messages")))


def pairs_from_messages(df: DataFrame, messages: str = "messages", id_col: str = "conv_id",
                        chunk_col: str | None = "chunk") -> DataFrame:
    """Last ``user`` content -> prompt, last ``assistant`` content -> response.

    The two are picked independently (the later message of each role wins);
    other roles are ignored; a missing role gives null.  With a ``chunk``
    column the last chunk holding each role wins.
    """
    has_user = F.exists(F.col(messages), lambda m: m["role"] == F.lit("user"))
    has_asst = F.exists(F.col(messages), lambda m: m["role"] == F.lit("assistant"))
    rows = df.select(*[c for c in df.columns if c != messages],
                     _last_content(messages, "user").alias("prompt"),
                     _last_content(messages, "assistant").alias("response"),
                     has_user.alias("_hu"), has_asst.alias("_ha"))
    if not chunk_col or chunk_col not in df.columns:
        return rows.drop("_hu", "_ha")
    return rows.groupBy(id_col).agg(
        F.expr(f"max_by(prompt, {chunk_col}) FILTER (WHERE _hu)").alias("prompt"),
        F.expr(f"max_by(response, {chunk_col}) FILTER (WHERE _ha)").alias("response"))


def pairs_from_turns(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Same rule on the normalized one-row-per-turn form, as one aggregation.

    ``max_by ... FILTER`` is partially aggregated map-side, so a conversation
    with millions of turns costs one row per partition in the shuffle.
    """
    return turns.groupBy(id_col).agg(
        F.expr(f"max_by({text_col}, {turn_col}) FILTER (WHERE {role_col} = 'user')").alias("prompt"),
        F.expr(f"max_by({text_col}, {turn_col}) FILTER (WHERE {role_col} = 'assistant')").alias("response"))


def resolve_pair_columns(columns: list[str], prompt_col: str = "prompt",
                         response_col: str = "response") -> tuple[str | None, str | None]:
    """Alias fallback decided once from the schema: absent -> the alias."""
    p = prompt_col if prompt_col in columns else ("instruction" if "instruction" in columns else None)
    r = response_col if response_col in columns else ("output" if "output" in columns else None)
    return p, r


def pairs_from_columns(df: DataFrame, prompt_col: str = "prompt", response_col: str = "response",
                       keep: list[str] | None = None) -> DataFrame:
    """Flat samples: ``prompt`` else ``instruction``; ``response`` else ``output``.

    A column absent from the schema contributes ``""`` (dropped later by
    ``nonempty_pairs``).  Null stays null (counted by the null profile) --
    the reference would turn it into the text "None".
    """
    p, r = resolve_pair_columns(df.columns, prompt_col, response_col)
    pc = F.col(p).cast("string") if p else F.lit("")
    rc = F.col(r).cast("string") if r else F.lit("")
    return df.select(*(keep or []), pc.alias("prompt"), rc.alias("response"))


def nonempty_pairs(df: DataFrame, prompt: str = "prompt", response: str = "response") -> DataFrame:
    """Drop a pair when either side is empty or null (whitespace-only is kept)."""
    return df.where((F.length(prompt) > 0) & (F.length(response) > 0))


def drop_null_pairs(df: DataFrame, subset: tuple[str, ...] = ("prompt", "response")) -> DataFrame:
    return df.na.drop(subset=list(subset))


def chat_template(df: DataFrame, template: str = DEFAULT_PROMPT_TEMPLATE,
                  suffix: str = RESPONSE_SUFFIX, prompt: str = "prompt",
                  response: str = "response") -> DataFrame:
    """Adds ``formatted_prompt`` and ``formatted_response``."""
    return df.withColumn("formatted_prompt", render_template(prompt, template)) \
             .withColumn("formatted_response", append_suffix(response, suffix))
