"""Order statistics by counting, against numpy."""

import math
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.operators import order_stats as O
from tunelake.operators import runs as R

QS = (0.0, 0.25, 0.5, 0.9, 0.99, 1.0)
SPECIAL = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, 0.9999999999999999, 1.0000000000000002,
           2.0, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1e-300, 3.0, 0.1, 2.0 ** 52, 2.0 ** -1000]


def test_keys_keep_the_order_and_give_the_value_back(spark):
    rng = random.Random(0)
    values = SPECIAL + [math.ldexp(1.0, e) * s for e in range(-1074, 1024, 3) for s in (1, -1)]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double") \
        .select("i", O.order_key(F.col("v")).alias("k")).collect()
    keys = {r.i: r.k for r in got}
    for i, v in enumerate(values):
        assert O.key_value(keys[i]) == v
    order = sorted(range(len(values)), key=lambda i: keys[i])
    assert all(values[a] <= values[b] for a, b in zip(order, order[1:]))
    none = spark.createDataFrame([(None,), (math.nan,)], "v double").select(O.order_key(F.col("v")).alias("k")).collect()
    assert none[0].k is None and math.isnan(O.key_value(none[1].k))


def groups():
    rng = random.Random(1)
    return {"hot": [rng.gauss(0, 1) for _ in range(4000)], "ties": [rng.choice([1.5, 2.5, -3.0]) for _ in range(500)],
            "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(700)],
            "near": [1.0 + k * 2 ** -52 for k in range(50)], "one": [7.25], "two": [1.0, 2.0], None: [1.0, 4.0, 9.0]}


@pytest.mark.parametrize("bins", [1 << 14, 4])
def test_quantiles_against_numpy(spark, monkeypatch, bins):
    monkeypatch.setattr(O, "BINS", bins)
    rows = [(g, v) for g, vs in groups().items() for v in vs] + [("hot", None), ("none", None)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double").repartition(6)
    got = {r.g: r for r in O.exact_quantiles(df, "v", QS, ["g"], [f"q{i}" for i in range(len(QS))]).collect()}
    assert set(got) == set(groups())
    for g, vs in groups().items():
        want = np.quantile(np.array(vs), QS)
        for i in range(len(QS)):
            assert got[g][f"q{i}"] == pytest.approx(want[i], rel=1e-12, abs=0)
    whole = O.exact_quantiles(df.where("g = 'hot'"), "v", (0.5,)).collect()
    assert whole[0].q50 == pytest.approx(np.median(groups()["hot"]))


def test_many_groups_and_empty_tables(spark, monkeypatch):
    df = spark.createDataFrame([(i % 30, float(i)) for i in range(300)], "g long, v double")
    want = sorted(map(tuple, O.exact_quantiles(df, "v", (0.5,), ["g"]).collect()))
    monkeypatch.setattr(O, "MAX_GROUPS", 10)
    assert sorted(map(tuple, O.exact_quantiles(df, "v", (0.5,), ["g"]).collect())) == want
    assert O.exact_quantiles(df.limit(0), "v", (0.5,), ["g"]).collect() == []
    assert O.exact_quantiles(df.limit(0), "v", (0.5,)).collect() == []


def test_plans_have_no_range_shuffle(spark):
    from tunelake.plans.catalog import QUERIES
    import io
    from contextlib import redirect_stdout
    out = io.StringIO()
    with redirect_stdout(out):
        QUERIES["latency_percentiles"](spark, "/root/testdata/sf0.001").explain("formatted")
    assert "rangepartitioning" not in out.getvalue() and "ExistingRDD" not in out.getvalue()
    assert "BroadcastHashJoin" in out.getvalue()


def test_skip_first(spark):
    rows = [("a", t, e) for t in range(4) for e in range(2)] + [("b", 1, 1), (None, 1, 1), (None, 1, 2), (None, 2, 0)]
    df = spark.createDataFrame(rows, "g string, ts long, id long").repartition(3)
    for k in (0, 1, 2, 3, 100):
        want = [r for g in ("a", "b", None) for r in sorted(x for x in rows if x[0] == g)[k:]]
        assert sorted(map(tuple, R.skip_first(df, "g", ["ts", "id"], k).collect()), key=str) == sorted(want, key=str)
