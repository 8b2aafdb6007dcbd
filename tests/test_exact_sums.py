"""Sums of doubles: equal to math.fsum, bit for bit the same for every cut."""

import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tunelake.operators import exact_sums as X
from tunelake.operators.segmented import running_aggregates


def bits(x):
    return None if x is None else "nan" if math.isnan(x) else struct.pack("<d", x + 0.0)


def wide(n, seed, low=-300, high=300):
    rng = random.Random(seed)
    return [rng.choice([-1, 1]) * rng.random() * 10.0 ** rng.uniform(low, high) for _ in range(n)]


def ulps(a, b):
    return 0 if a == b else abs(a - b) / math.ulp(max(abs(a), abs(b)))


CASES = {"wide": wide(300, 1), "close": wide(300, 2, -3, 3), "tiny": [1e-20] * 7 + [5e-324, 2.2e-308, 1e-310],
         "large": [1e300, 1.7e308, -1.7e308, 1e21, 1.0, -1e300], "cancel": [1e16, 1.0, -1e16, 1e-16, 3.0, -3.0],
         "equal": [0.1] * 50, "zeros": [0.0, -0.0, 0.0], "one": [math.pi]}


@pytest.mark.parametrize("name", CASES)
def test_running_sum_for_every_cut(spark, name):
    values = CASES[name]
    df = spark.createDataFrame([(i, "g" if i % 3 else None, v) for i, v in enumerate(values)], "i long, g string, v double").repartition(5)
    got = []
    for blocks in (1, 8, 200):
        r = running_aggregates(df, ["g"], ["i"], {"s": ("sum", F.col("v"), True), "e": ("sum", F.col("v"), False)}, blocks)
        got.append({row.i: (bits(row.s), bits(row.e), row.s) for row in r.collect()})
    assert got[0] == got[1] == got[2]
    for g in ("g", None):
        seen = []
        for i, v in enumerate(values):
            if ("g" if i % 3 else None) == g:
                assert got[0][i][1] == bits(math.fsum(seen) if seen else None) or ulps(math.fsum(seen), struct.unpack("<d", got[0][i][1])[0]) <= 1
                seen.append(v)
                assert ulps(got[0][i][2], math.fsum(seen)) <= 1


def test_special_values_and_nulls(spark):
    rows = [("a", 1.0), ("a", math.inf), ("b", -math.inf), ("b", 2.0), ("c", math.inf), ("c", -math.inf), ("d", math.nan),
            ("e", None), ("f", 1e-300), ("f", None), ("g", 1e300), ("g", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(4)
    got = {r.g: r.s for r in X.exact_sum(df, ["g"], {"s": F.col("v")}).collect()}
    assert got["a"] == math.inf and got["b"] == -math.inf and math.isnan(got["c"]) and math.isnan(got["d"])
    assert got["e"] is None and got["f"] == 1e-300 and got["g"] == 1e300
    run = running_aggregates(df.where("g <= 'b'"), ["g"], ["v"], {"s": ("sum", F.col("v"), True)}, 3).collect()
    assert sorted((r.g, r.s) for r in run) == [("a", 1.0), ("a", math.inf), ("b", -math.inf), ("b", -math.inf)]


def test_sum_by_group_does_not_depend_on_partitions(spark):
    values = wide(2000, 9, -20, 20)
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "g long, v double")
    got = [{r.g: (bits(r.s), r.n) for r in X.exact_sum(df.repartition(p), ["g"], {"s": F.col("v")}, [F.count("*").alias("n")]).collect()}
           for p in (1, 7)]
    assert got[0] == got[1]
    for g, (b, n) in got[0].items():
        assert ulps(struct.unpack("<d", b)[0], math.fsum(values[g::3])) <= 1 and n == len(values[g::3])


def test_empty_and_all_null(spark):
    assert X.exact_sum(spark.createDataFrame([], "g long, v double"), ["g"], {"s": F.col("v")}).collect() == []
    df = spark.createDataFrame([(1, None)], "g long, v double")
    assert [r.s for r in running_aggregates(df, ["g"], ["g"], {"s": ("sum", F.col("v"), True)}, 2).collect()] == [None]
