"""Registered queries that run as streams over the tables, to the end of their source.

Each compares with the same DuckDB SQL as its batch twin.  The stand-in
inputs only add the columns that the job expects (an event time, a map of
metrics) and the last row that moves the watermark to the end.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.operators import splits as S
from tunelake.operators.pairs import fold_messages
from tunelake.operators.segmented import global_position
from tunelake.plans import derived as D
from tunelake.plans.catalog import MAX_TO_KEEP, query
from tunelake.session import work_folder
from tunelake.sources import readers as R
from tunelake.sources.tables import load_table
from tunelake.streaming import jobs as J
from tunelake.streaming import stateful as ST

BUFFER = 64          # fewer than the documents of any test table, so that rows push each other out
GAP = "10 minutes"
START = 1_700_000_000  # a watermark starts at 1970: earlier times would be late
ALL_FILES = 1 << 30  # one micro-batch: what one run decides is compared, not how files are cut


def _streamed(spark: SparkSession, rows: DataFrame, name: str, files: int = ALL_FILES) -> tuple[DataFrame, str]:
    """The rows as a stream of files, and a folder for the stream's results."""
    folder = work_folder(spark, name)
    rows.write.parquet(f"{folder}/in")
    return R.stream_pairs_source(spark, f"{folder}/in", rows.schema, files, "parquet"), folder


def turns_with_time(spark, sf_dir):
    """A turn a minute, a day for each conversation, half an hour's pause after every eight turns."""
    seconds = START + F.col("conv_id") * 86400 + F.col("turn") * 60 + F.floor(F.col("turn") / 8) * 1800
    return load_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", "text", F.timestamp_seconds(seconds).alias("ts"))


@query
def stream_turns(spark, sf_dir):
    """The conversation table read as a stream, one file at a time."""
    return J.run_to_table(R.stream_pairs_source(spark, f"{sf_dir}/conversations.parquet", R.TURNS_SCHEMA, 1),
                          work_folder(spark, "stream-turns"))


@query
def stream_instructions(spark, sf_dir):
    """Messages to rendered pairs and token lengths."""
    folded = fold_messages(load_table(spark, sf_dir, "conversations"), chunk_turns=1 << 30).drop("chunk")
    stream, folder = _streamed(spark, folded, "stream-instructions", 1)
    return J.run_to_table(J.instruction_stream(stream), folder)


@query
def fold_turns(spark, sf_dir):
    """P2 with sessions, as a batch."""
    return _in_seconds(ST.fold_turns(turns_with_time(spark, sf_dir), GAP))


def _in_seconds(pairs: DataFrame) -> DataFrame:
    for c in ("session_start", "session_end"):
        pairs = pairs.withColumn(c, F.unix_seconds(c))
    return pairs


@query
def stream_fold_turns(spark, sf_dir):
    """Turns that arrive in any order, folded by session."""
    turns = turns_with_time(spark, sf_dir)
    last = spark.createDataFrame([(None, None, None, None, ST.END_OF_STREAM)], turns.schema)
    shuffled = turns.repartition(4, F.xxhash64("text")).unionByName(last)
    stream, folder = _streamed(spark, shuffled, "stream-fold")
    return _in_seconds(J.run_to_table(ST.fold_turns(stream, GAP), folder))


@query
def buffer_shuffle(spark, sf_dir):
    """A shuffle with a buffer, as a batch."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id")
    return S.buffer_shuffle(docs, "doc_id", buffer_size=BUFFER)


@query
def stream_buffer_shuffle(spark, sf_dir):
    """The same shuffle on a stream, rows arriving in the order of their time."""
    docs = load_table(spark, sf_dir, "documents").select("doc_id", F.timestamp_seconds(START + F.col("doc_id")).alias("ts"))
    last = spark.createDataFrame([(None, ST.END_OF_STREAM + dt.timedelta(days=1))], docs.schema)
    stream, folder = _streamed(spark, docs.unionByName(last), "stream-shuffle")
    with ST.with_state_store(spark):
        out = J.run_to_table(ST.shuffle_stream(stream, "doc_id", "ts", BUFFER, groups=8), folder)
    return global_position(out, S.pushed_order("doc_id")).select("doc_id", "pushed_by", "shuffle_key", "position")


@query
def stream_checkpoints(spark, sf_dir):
    """W1/W2 as checkpoints arrive: best so far and the step that each one purges."""
    stream, folder = _streamed(spark, D.ckpt_log(spark, sf_dir), "stream-checkpoints")
    with ST.with_state_store(spark):
        return J.run_to_table(ST.checkpoint_stream(stream, max_to_keep=MAX_TO_KEEP), folder)


@query
def stream_retention(spark, sf_dir):
    """The keep/purge plan that follows from those decisions."""
    return ST.retention_plan(stream_checkpoints(spark, sf_dir))


@query
def stream_perplexity(spark, sf_dir):
    """Perplexity of each run, kept as state and written out complete."""
    log = D.loss_log(spark, sf_dir).select("run", "step", "loss", "num_tokens")
    stream, folder = _streamed(spark, log, "stream-perplexity")
    return J.run_complete(J.online_perplexity(stream), folder)


@query
def stream_metric_targets(spark, sf_dir):
    """The metric log to two targets, each row once in each."""
    log = D.loss_log(spark, sf_dir).select("run", "step", F.create_map(
        F.lit("train/loss"), F.col("loss"), F.lit("train/num_tokens"), F.col("num_tokens").cast("double")).alias("metrics"))
    stream, folder = _streamed(spark, log, "stream-targets")
    targets = {"parquet": J.file_target(f"{folder}/parquet"), "json": J.file_target(f"{folder}/json", "json")}
    J.metric_log_targets(stream, targets, f"{folder}/checkpoint").awaitTermination()
    schema = "run long, step long, key string, value double"
    parts = [spark.read.schema(schema).format(fmt).load(f"{folder}/{fmt}/batch_id=*").withColumn("target", F.lit(fmt))
             for fmt in targets]
    return parts[0].unionByName(parts[1])
