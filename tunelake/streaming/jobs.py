"""Streaming jobs built from the same DataFrame functions as the batch path.

T1 instruction_stream  -- stateless: messages -> pairs -> template -> lengths
T2 online_perplexity   -- running perplexity per run (built-in aggregation state)
T3 metric_log_stream   -- continuous (run, step, key, value) log, appended
T3 metric_log_targets  -- the same log to several targets, each row once in each
(Jobs with state of their own are in ``stateful``.)
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tunelake.functions.text import DEFAULT_PROMPT_TEMPLATE, whitespace_tokens
from tunelake.operators.losses import perplexity, perplexity_by_group, valid_loss
from tunelake.operators.pairs import chat_template, nonempty_pairs, pairs_from_messages
from tunelake.operators.profile import with_token_lengths


def instruction_stream(messages: DataFrame, id_col: str = "conv_id",
                       template: str = DEFAULT_PROMPT_TEMPLATE, tokens_fn=whitespace_tokens) -> DataFrame:
    """Row-local: works identically on a batch or a streaming DataFrame of
    chat-form rows (one row per sample)."""
    p = pairs_from_messages(messages.select(id_col, "messages"), chunk_col=None)
    p = chat_template(nonempty_pairs(p), template)
    return with_token_lengths(p, tokens_fn=tokens_fn).select(
        id_col, "formatted_prompt", "formatted_response", "prompt_tokens", "response_tokens", "total_tokens")


def online_perplexity(loss_log: DataFrame, group=("run",)) -> DataFrame:
    """Per-group token-weighted perplexity; state is one row per group.
    Run with outputMode ``update`` or ``complete``."""
    return perplexity_by_group(loss_log, list(group))


def online_perplexity_windowed(loss_log: DataFrame, ts: str = "ts", window: str = "1 hour",
                               watermark: str = "2 hours", group=("run",)) -> DataFrame:
    """Event-time variant for long-lived streams: tumbling windows closed by a
    watermark, so state stays bounded and ``append`` mode is possible."""
    ok = valid_loss(F.col("loss"))
    agg = (loss_log.withWatermark(ts, watermark)
           .groupBy(F.window(ts, window).alias("window"), *group)
           .agg(F.sum(F.when(ok, F.col("loss") * F.col("num_tokens"))).alias("_tl"),
                F.sum(F.when(ok, F.col("num_tokens"))).alias("_tt"),
                F.count_if(ok).cast("bigint").alias("steps")))
    ml = F.when(F.coalesce(F.col("_tt"), F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col("_tl") / F.col("_tt"))
    return agg.select("window", *group, "steps", ml.alias("mean_loss"), perplexity(ml).alias("perplexity"))


def metric_rows(log: DataFrame, run: str = "run", step: str = "step", metrics: str = "metrics") -> DataFrame:
    """(run, step, key, value) from a ``map<string,double>``; null values are
    dropped (only numbers are logged)."""
    return log.select(run, step, F.explode(metrics).alias("key", "value")).where(F.col("value").isNotNull())


# A folder for each run would be as many folders as runs.
LOG_BUCKETS = 64


def log_bucket(run):
    return F.pmod(F.xxhash64(run), F.lit(LOG_BUCKETS)).cast("int")


def write_metric_log(rows: DataFrame, path: str) -> None:
    """Batch append of metric rows, in ``LOG_BUCKETS`` folders by a hash of the run."""
    rows.withColumn("bucket", log_bucket(F.col("run"))).write.mode("append").partitionBy("bucket").parquet(path)


def metric_log_stream(log: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                      query_name: str | None = None) -> StreamingQuery:
    """Continuous metric log: append to parquet with a checkpoint (exactly-once
    file sink).  Stopping the query is the ``close``."""
    w = (metric_rows(log).withColumn("bucket", log_bucket(F.col("run"))).writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).partitionBy("bucket").outputMode("append"))
    if query_name:
        w = w.queryName(query_name)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def file_target(path: str, fmt: str = "parquet") -> Callable[[DataFrame, int], None]:
    """A target that keeps each micro-batch in a folder of its own, which a replay overwrites."""
    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").format(fmt).save(f"{path}/batch_id={batch_id}")
    return write


class Ledger:
    """Finished (batch, target) pairs, one empty file each, on the file system of ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.root = root

    def _entry(self, batch_id: int, target: str):
        return self._path(f"{self.root}/{target}/{batch_id}")

    def done(self, batch_id: int, target: str) -> bool:
        return self._fs.exists(self._entry(batch_id, target))

    def mark(self, batch_id: int, target: str) -> None:
        self._fs.create(self._entry(batch_id, target), True).close()


def metric_log_targets(log: DataFrame, targets: dict[str, Callable[[DataFrame, int], None]], checkpoint: str,
                       available_now: bool = True) -> StreamingQuery:
    """Continuous metric log to several targets: ``targets`` maps a name to a function (rows, batch id).

    A target that has finished a micro-batch is written into a ledger beside the
    checkpoint.  If one target fails, the others still get the batch; the query
    then stops, and its replay writes only to the targets that lack the batch.  A
    target that can fail half-way should overwrite its own batch, as ``file_target`` does.
    """
    ledger = Ledger(log.sparkSession, f"{checkpoint}/targets")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        waiting = [name for name in targets if not ledger.done(batch_id, name)]
        failed = {}
        batch.persist()  # the rows are read once for all targets
        try:
            for name in waiting:
                try:
                    targets[name](batch, batch_id)
                    ledger.mark(batch_id, name)
                except Exception as error:  # the other targets go on; the batch is replayed for this one
                    failed[name] = error
        finally:
            batch.unpersist()
        if failed:
            raise RuntimeError(f"batch {batch_id} is missing in {sorted(failed)}") from next(iter(failed.values()))

    w = metric_rows(log).writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Drive a streaming DataFrame to the end of its source into a parquet table under ``path`` and read that."""
    q = (df.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint")
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")


def run_complete(df: DataFrame, path: str) -> DataFrame:
    """Drive a streaming aggregation to the end of its source; read the table that its last micro-batch wrote."""
    def write_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/complete")

    q = (df.writeStream.foreachBatch(write_batch).option("checkpointLocation", f"{path}/checkpoint")
         .outputMode("complete").trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/complete")


def run_to_memory(df: DataFrame, name: str, mode: str = "append", checkpoint: str | None = None) -> StreamingQuery:
    """Drive a streaming DataFrame to completion into a memory table (tests)."""
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
    if checkpoint:
        w = w.option("checkpointLocation", checkpoint)
    q = w.start()
    q.awaitTermination()
    return q


def stream_training_sequences(messages: DataFrame, vocab: DataFrame, path: str, checkpoint: str,
                              id_col: str = "conv_id", max_len: int = 2048,
                              available_now: bool = True) -> StreamingQuery:
    """Chat-form stream -> masked training sequences, appended as parquet.

    Encoding regroups each sample's tokens, which is a per-sample aggregation;
    on a stream that would need state.  ``foreachBatch`` instead runs the
    batch functions on each micro-batch (every sample is one row of one
    micro-batch, so the regroup is complete) against a fixed vocabulary.
    Each micro-batch overwrites its own ``epoch_id=`` folder, so a batch that
    is replayed after a failure replaces what its first run left.
    """
    from tunelake.operators.sequences import build_sequences
    from tunelake.plans.training_data import encoded_pairs

    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        pairs = nonempty_pairs(pairs_from_messages(batch.select(id_col, "messages"), chunk_col=None))
        seqs = build_sequences(encoded_pairs(pairs, id_col, vocab=vocab), max_len=max_len)
        seqs.write.mode("overwrite").parquet(f"{path}/epoch_id={epoch_id}")

    w = messages.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
