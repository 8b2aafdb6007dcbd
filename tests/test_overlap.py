"""Clipped overlaps against counters; encoding against a dictionary."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tunelake.functions.overlap import clipped_overlaps
from tunelake.operators import vocab as V


def grams(tokens, n):
    return Counter(tuple(tokens[i:i + n]) for i in range(len(tokens) - n + 1)) if tokens else Counter()


def lists(n, seed):
    rng = random.Random(seed)
    one = [[rng.choice(["a", "b", "c", "", "ä b", "a b"]) for _ in range(rng.randrange(0, 14))] for _ in range(n)]
    return one + [None, [], ["a"], ["x"] * 3000]


def test_clipped_overlaps_against_counters(spark):
    pred, ref = lists(150, 1), lists(150, 2)
    df = spark.createDataFrame([(i, p, r) for i, (p, r) in enumerate(zip(pred, ref))], "i long, p array<string>, r array<string>")
    for orders in ((1, 2, 3, 4), (2,)):
        got = {r.i: r.o for r in df.repartition(3).select("i", clipped_overlaps(F.col("p"), F.col("r"), orders).alias("o")).collect()}
        for i, (p, r) in enumerate(zip(pred, ref)):
            assert got[i] == [sum((grams(p, n) & grams(r, n)).values()) for n in orders]
    assert df.limit(0).select(clipped_overlaps(F.col("p"), F.col("r")).alias("o")).collect() == []


def test_encoding_against_a_dictionary(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 7)
    a, b = lists(60, 3), lists(60, 4)
    rows = [(i % 40, x, y) for i, (x, y) in enumerate(zip(a, b))] + [(None, ["a", None, "zzz"], [None])]  # repeated and null ids
    df = spark.createDataFrame(rows, "id long, a array<string>, b array<string>").repartition(4)
    for size in (None, 2, 0):
        vocab = V.vocab_table(df, F.concat(F.coalesce("a", F.array()), F.coalesce("b", F.array())), size)
        ids = {r.token: r.id for r in vocab.collect()}
        counts = Counter(t for _, x, y in rows for t in [*(x or []), *(y or [])] if t is not None)
        want = {t: k + 2 for k, (t, _) in enumerate(sorted(counts.items(), key=lambda kv: (-kv[1], kv[0])))}
        assert ids == {t: k for t, k in want.items() if size is None or k < size + 2}

        def enc(x):
            return [None if t is None else ids.get(t, 1) for t in x or []]
        got = V.encode_columns(df, "id", {"a": F.col("a"), "b": F.col("b")}, vocab).collect()
        assert sorted(((r.id, r.a_ids, r.b_ids) for r in got), key=str) == sorted(((i, enc(x), enc(y)) for i, x, y in rows), key=str)
