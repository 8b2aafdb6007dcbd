import os

import pytest
from pyspark.sql import functions as F

from tunelake.operators.losses import perplexity_by_group
from tunelake.operators.pairs import fold_messages
from tunelake.plans import derived as D
from tunelake.sources.readers import stream_pairs_source
from tunelake.sources.tables import load_table
from tunelake.streaming import jobs as J

from paths import SF_ORACLE


def _write_parts(df, path, n=4):
    df.repartition(n).write.mode("overwrite").parquet(path)


def test_instruction_stream_equals_batch(spark, tmpdir_fresh):
    turns = load_table(spark, SF_ORACLE, "conversations")
    msgs = fold_messages(turns, chunk_turns=1 << 20).drop("chunk")
    src = os.path.join(tmpdir_fresh, "msgs")
    _write_parts(msgs, src)
    batch = J.instruction_stream(spark.read.parquet(src))
    stream = J.instruction_stream(stream_pairs_source(spark, src, spark.read.parquet(src).schema))
    J.run_to_memory(stream, "t1_out", checkpoint=os.path.join(tmpdir_fresh, "ck1"))
    out = spark.table("t1_out")
    assert out.count() == batch.count() == 98
    assert out.exceptAll(batch).count() == 0 and batch.exceptAll(out).count() == 0


def test_online_perplexity_equals_batch(spark, tmpdir_fresh):
    ll = D.loss_log(spark, SF_ORACLE)
    src = os.path.join(tmpdir_fresh, "loss")
    _write_parts(ll, src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    J.run_to_memory(J.online_perplexity(stream), "t2_out", mode="complete",
                    checkpoint=os.path.join(tmpdir_fresh, "ck2"))
    got = {r.run: r.perplexity for r in spark.table("t2_out").collect()}
    want = {r.run: r.perplexity for r in perplexity_by_group(ll, ["run"]).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-12)


def test_metric_log_stream_rows(spark, tmpdir_fresh):
    rows = [("r1", 1, {"train/loss": 1.25, "train/ppl": 3.49}), ("r1", 2, {"train/loss": None})]
    df = spark.createDataFrame(rows, "run string, step bigint, metrics map<string,double>")
    src = os.path.join(tmpdir_fresh, "m")
    df.write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    out = os.path.join(tmpdir_fresh, "log")
    q = J.metric_log_stream(stream, out, os.path.join(tmpdir_fresh, "ck3"))
    q.awaitTermination()
    got = sorted((r.step, r.key, r.value) for r in spark.read.parquet(out).collect())
    assert got == [(1, "train/loss", 1.25), (1, "train/ppl", 3.49)]
    J.write_metric_log(J.metric_rows(df), os.path.join(tmpdir_fresh, "batchlog"))
    assert spark.read.parquet(os.path.join(tmpdir_fresh, "batchlog")).count() == 2


def test_windowed_perplexity_plans(spark, tmpdir_fresh):
    ll = D.loss_log(spark, SF_ORACLE).withColumn("ts", F.col("ts").cast("timestamp"))
    src = os.path.join(tmpdir_fresh, "lossw")
    _write_parts(ll, src, 2)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    J.run_to_memory(J.online_perplexity_windowed(stream, window="1 day", watermark="1 day"), "t2w_out",
                    mode="append", checkpoint=os.path.join(tmpdir_fresh, "ck4"))
    got = spark.table("t2w_out")
    # Append mode emits a window once the watermark has passed it; every
    # emitted window must equal the batch computation of the same window.
    batch = J.online_perplexity_windowed(spark.read.parquet(src), window="1 day", watermark="1 day")
    assert got.count() > 0
    j = got.alias("g").join(batch.alias("b"), on=["window", "run"])
    assert j.count() == got.count()
    assert j.where("abs(g.perplexity - b.perplexity) > 1e-9 OR g.steps <> b.steps").count() == 0


def test_stream_training_sequences_equal_batch(spark, tmpdir_fresh):
    from tunelake.functions.text import whitespace_tokens
    from tunelake.operators.pairs import chat_template, nonempty_pairs, pairs_from_messages
    from tunelake.operators.vocab import vocab_table
    from tunelake.plans.training_data import training_sequences
    turns = load_table(spark, SF_ORACLE, "conversations")
    msgs = fold_messages(turns, chunk_turns=1 << 20).drop("chunk")
    src = os.path.join(tmpdir_fresh, "msgs")
    _write_parts(msgs, src, 3)
    batch_pairs = nonempty_pairs(pairs_from_messages(spark.read.parquet(src), chunk_col=None))
    t = chat_template(batch_pairs).select(F.concat(whitespace_tokens("formatted_prompt"),
                                                   whitespace_tokens("formatted_response")).alias("t"))
    vocab = vocab_table(t, "t", 500)  # small: exercises unknown tokens
    want = training_sequences(batch_pairs, vocab=vocab).select("conv_id", "input_ids", "labels")
    out = os.path.join(tmpdir_fresh, "seqs")
    stream = stream_pairs_source(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)
    q = J.stream_training_sequences(stream, vocab, out, os.path.join(tmpdir_fresh, "ck5"))
    q.awaitTermination()
    got = spark.read.parquet(out).select("conv_id", "input_ids", "labels")
    assert got.count() == want.count() == 98
    assert got.exceptAll(want).count() == 0
    # Every micro-batch once more, as after a failure before its commit: nothing is doubled.
    J.stream_training_sequences(stream, vocab, out, os.path.join(tmpdir_fresh, "ck6")).awaitTermination()
    assert spark.read.parquet(out).count() == 98
    assert spark.read.parquet(out).select("epoch_id").distinct().count() >= 2  # several micro-batches
