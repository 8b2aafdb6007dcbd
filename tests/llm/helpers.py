"""Shared fixtures of the corpus operator tests."""

import random

WORDS = "the of and to in a ering thand onest wher thing ation eaed hering thation ofer".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "er", str(rng.randrange(9))]) for _ in range(n))


def odd_documents(spark, seed=1, n=30):
    """Nulls in every column, empty and long texts, repeated rows, copies, clashing extra columns."""
    rng = random.Random(seed)
    base = [text(rng, rng.randint(1, 120)) for _ in range(n)]
    rows = [(i, base[i]) for i in range(n)]
    rows += [(n + i, base[i]) for i in range(5)]                                  # copies
    rows += [(n + 10 + i, base[i] + " " + text(rng, 2)) for i in range(5)]        # near copies
    rows += [(n + 20, None), (n + 21, ""), (n + 22, " \t\n "), (None, base[3]), (None, None), (3, base[3])]
    rows += [(n + 30, text(rng, 6000)), (n + 31, "x" * 5000), (n + 32, "Ünï «ß» 中文 \U0001f600 " + base[7])]
    data = [(d, t, None if d is None else d % 3, "a", t, 7) for d, t in rows]
    df = spark.createDataFrame(data, "doc_id long, text string, score int, key string, blob string, part int")
    return df.repartition(3), rows


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, kept int")
