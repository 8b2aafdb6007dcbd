"""Inputs derived from the driver tables (definitions fixed in FIXTURES.md).

The same definitions are written in SQL in ``tunelake.plans.oracle`` so that
Spark and DuckDB start from identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.operators.pairs import pairs_from_turns, nonempty_pairs
from tunelake.operators.segmented import row_ordinal
from tunelake.sources.tables import load_table


def props_k(col: str = "props"):
    """The integer ``k`` of the JSON ``props`` column."""
    return F.get_json_object(F.col(col), "$.k").cast("bigint")


def loss_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, ts, loss, num_tokens): one optimizer step per event.

    ``step`` is the 1-based position of the event within its user by
    (ts, event_id); computed with the skew-safe ordinal.
    """
    return row_ordinal(loss_events(spark, sf_dir), ["run"], ["ts", "event_id"], name="step") \
        .select("run", "step", "ts", "event_id", "loss", "num_tokens")


def loss_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``loss_log`` in the order (ts, event_id), without a step."""
    return load_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id",
        (F.col("value") / F.lit(100.0)).alias("loss"),
        props_k().alias("num_tokens"))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(group_id, sample_id, base, fused): odd steps are base, even steps fused."""
    ll = loss_log(spark, sf_dir)
    return (ll.groupBy(F.col("run").alias("group_id"),
                       F.floor((F.col("step") + 1) / 2).cast("bigint").alias("sample_id"))
              .agg(F.max(F.when(F.col("step") % 2 == 1, F.col("loss"))).alias("base"),
                   F.max(F.when(F.col("step") % 2 == 0, F.col("loss"))).alias("fused"))
              .where(F.col("base").isNotNull() & F.col("fused").isNotNull()))


def ckpt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, metrics map<string,double>) -- one checkpoint per event."""
    return row_ordinal(ckpt_events(spark, sf_dir), ["run"], ["ts", "event_id"], name="step").select("run", "step", "metrics")


def ckpt_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``ckpt_log`` in the order (ts, event_id), without a step."""
    return load_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"), "ts", "event_id", F.create_map(F.lit("eval_loss"), F.col("value")).alias("metrics"))


def gen_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, sample, tokens, seconds) generation records."""
    return load_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("variant"), F.col("event_id").alias("sample"),
        props_k().alias("tokens"), F.col("value").alias("seconds"))


def latency_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(variant, seq, elapsed_ms, peak_mb); seq by (ts, event_id) per variant."""
    ev = load_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("variant"), "ts", "event_id",
        F.col("value").alias("elapsed_ms"), props_k().cast("double").alias("peak_mb"))
    return row_ordinal(ev, ["variant"], ["ts", "event_id"], name="seq") \
        .select("variant", "seq", "elapsed_ms", "peak_mb")


def latency_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of ``latency_log`` in the order (ts, event_id), without a sequence number."""
    return load_table(spark, sf_dir, "events").select(
        F.col("event_type").alias("variant"), "ts", "event_id",
        F.col("value").alias("elapsed_ms"), props_k().cast("double").alias("peak_mb"))


def memory_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device, ts, event_id, allocated, reserved, max_allocated, total) in GB."""
    ev = load_table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") % 4).alias("device"), "ts", "event_id",
        F.col("value").alias("allocated"),
        (F.col("value") + props_k().cast("double")).alias("reserved"),
        F.col("value").alias("max_allocated"),
        F.lit(1000.0).alias("total"))


def pairs_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last user / last assistant text per conversation (nulls kept)."""
    return pairs_from_turns(load_table(spark, sf_dir, "conversations"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pairs_raw`` with both sides non-null and non-empty: (conv_id, prompt, response)."""
    return nonempty_pairs(pairs_raw(spark, sf_dir))
