import random

import pytest
from pyspark.sql import functions as F

from tunelake.operators import batching as B
from tunelake.operators import sequences as Q
from tunelake.operators import vocab as V
from tunelake.operators.splits import hash_split, seeded_shuffle


def ref_rule(p, r, max_len):
    ids = (p + r)[:max_len]
    labels = [-100] * len(ids) if len(p) >= len(ids) else [-100] * len(p) + ids[len(p):]
    return ids, labels, [1] * len(ids)


def test_sequences_equal_reference_rule(spark):
    rnd = random.Random(3)
    rows = []
    for i in range(200):
        p = [rnd.randint(2, 50) for _ in range(rnd.randint(0, 12))]
        r = [rnd.randint(2, 50) for _ in range(rnd.randint(0, 12))]
        rows.append((i, p, r))
    df = spark.createDataFrame(rows, "id int, prompt_ids array<bigint>, response_ids array<bigint>")
    for max_len in (1, 5, 2048):
        got = {x.id: (x.input_ids, x.labels, x.attention_mask) for x in Q.build_sequences(df, max_len=max_len).collect()}
        for i, p, r in rows:
            assert got[i] == ref_rule(p, r, max_len)


def test_supervised_count_and_suffix(spark):
    df = spark.createDataFrame([([-100, -100, 5, 6],), ([-100],)], "labels array<bigint>")
    got = [r.n for r in df.select(Q.supervised_tokens(F.col("labels")).alias("n")).collect()]
    assert got == [2, 0]
    s = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([1, 2], [1, 2])], "i array<bigint>, o array<bigint>")
    assert [r.s for r in s.select(Q.generated_suffix(F.col("i"), F.col("o")).alias("s")).collect()] == [[3, 4], []]


def test_vocab_and_unknown_tokens(spark):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["a", "d"]), (3, [])], "id bigint, t array<string>")
    voc = V.vocab_table(df, "t", size=2)
    assert [(r.token, r["count"], r.id) for r in voc.orderBy("id").collect()] == [("a", 3, 2), ("b", 1, 3)]
    enc = {r.id: r.t_ids for r in V.encode_columns(df, "id", {"t": F.col("t")}, voc).collect()}
    assert enc == {1: [2, 3, 2, 1], 2: [2, 1], 3: []}


def test_padded_batches(spark):
    df = spark.createDataFrame([(i, list(range(1, i + 2)), [-100] * (i + 1), [1] * (i + 1)) for i in range(5)],
                               "id bigint, input_ids array<bigint>, labels array<bigint>, attention_mask array<bigint>")
    df = df.withColumn("position", F.col("id"))
    rows = B.padded_batches(df, batch_size=2, pad_id=9).orderBy("id").collect()
    assert rows[0].input_ids == [1, 9] and rows[0].attention_mask == [1, 0] and rows[0].labels == [-100, -100]
    assert rows[1].input_ids == [1, 2]
    assert rows[4].batch_id == 2 and rows[4].batch_max_len == 5  # incomplete last batch
    for r in rows:
        assert len(r.input_ids) == len(r.labels) == len(r.attention_mask) == r.batch_max_len


def test_pad_id_resolution():
    assert B.resolve_pad_id(None, 7) == 7 and B.resolve_pad_id(None, None) == 0
    assert B.resolve_pad_id([5, 6], 7) == 5


def test_accumulation_plan_wraps_epochs(spark):
    batches = spark.createDataFrame([(0, 2), (1, 2), (2, 1)], "batch_id bigint, batch_rows bigint")
    plan = B.accumulation_plan(batches, 3, grad_accum=2, max_steps=4).orderBy("step", "micro_step").collect()
    assert len(plan) == 8
    assert [(r.epoch, r.batch_id) for r in plan[:4]] == [(0, 0), (0, 1), (0, 2), (1, 0)]
    assert plan[-1].step == 3


def test_shuffle_and_split_are_partitioning_independent(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "doc_id")
    a = {r.doc_id: r.position for r in seeded_shuffle(df, "doc_id").collect()}
    b = {r.doc_id: r.position for r in seeded_shuffle(df.repartition(7), "doc_id").collect()}
    assert a == b and sorted(a.values()) == list(range(500))
    s1 = {r.doc_id: r.split for r in hash_split(df, "doc_id").collect()}
    s2 = {r.doc_id: r.split for r in hash_split(df.repartition(3), "doc_id").collect()}
    assert s1 == s2 and set(s1.values()) <= {"train", "validation", "test"}
    assert 400 < sum(v == "train" for v in s1.values()) < 500


def test_every_token_has_an_id_and_rows_stay_apart(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"]), (1, ["c", "a", "a"]), (2, None)], "id bigint, t array<string>")
    voc = V.vocab_table(df, "t")
    ids = {r.token: r.id for r in voc.collect()}
    assert ids == {"a": 2, "c": 3, "b": 4}
    enc = sorted((r.id, r.t_ids) for r in V.encode_columns(df, "id", {"t": F.col("t")}, voc).collect())
    assert enc == [(1, [2, 4, 3]), (1, [3, 2, 2]), (2, [])]


def test_ids_of_a_user_tokenizer(spark):
    from tunelake.plans.training_data import training_sequences
    pairs = spark.createDataFrame([(1, "ab cd", "e")], "conv_id bigint, prompt string, response string")
    template = "{instruction}"
    s = training_sequences(pairs, tokenizer=lambda: lambda t: [ord(c) for c in t], template=template).first()
    n = len(s.prompt_ids)
    assert s.labels[:n] == [-100] * n and s.labels[n:] == s.input_ids[n:] and chr(s.labels[n]) == "e"
