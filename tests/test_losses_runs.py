import math

import pytest
from pyspark.sql import functions as F

from tunelake.operators import losses as L
from tunelake.operators import runs as RU

INF, NAN = float("inf"), float("nan")

# Loss-log cases of the reference tests: (rows (loss, tokens), mean loss, perplexity)
CASES = {
    "one": ([(2.0, 10)], 2.0, math.exp(2.0)),
    "weighted": ([(2.0, 10), (1.0, 30)], 1.25, 3.490342957),
    "equal": ([(2.0, 10), (1.0, 10)], 1.5, 4.481689070),
    "invalid": ([(1.5, 10), (NAN, 10), (INF, 10), (-INF, 10), (None, 10)], 1.5, math.exp(1.5)),
    "cap": ([(200.0, 1)], 200.0, 2.6881171418161356e43),
    "cap_larger": ([(500.0, 1)], 500.0, math.exp(100.0)),
    "no_tokens": ([(3.0, 0)], 0.0, 1.0),
    "negative": ([(-1.0, 4)], -1.0, 1.0),
}


def test_perplexity_by_group_golden(spark):
    rows = [(k, i, l, t) for k, (rs, _, _) in CASES.items() for i, (l, t) in enumerate(rs)]
    df = spark.createDataFrame(rows, "run string, step int, loss double, num_tokens bigint")
    got = {r.run: r for r in L.perplexity_by_group(df, ["run"]).collect()}
    for k, (_, mean, ppl) in CASES.items():
        assert got[k].mean_loss == pytest.approx(mean), k
        assert got[k].perplexity == pytest.approx(ppl, rel=1e-9), k
    assert got["invalid"].steps == 1


def test_running_perplexity_and_reset_by_key(spark):
    df = spark.createDataFrame([("a", 1, 2.0, 10), ("a", 2, 1.0, 30), ("b", 1, 3.5, 100)],
                               "run string, step int, loss double, num_tokens bigint")
    got = {(r.run, r.step): r.running_loss for r in L.running_perplexity(df, ["run"], ["step"]).collect()}
    assert got == {("a", 1): 2.0, ("a", 2): 1.25, ("b", 1): 3.5}  # a new key is a reset


def test_train_log_intervals(spark):
    import datetime as dt
    t0 = dt.datetime(2024, 1, 1)
    rows = [("r", s, t0 + dt.timedelta(seconds=s), 0.5) for s in range(1, 26)]
    df = spark.createDataFrame(rows, "run string, step bigint, ts timestamp, loss double")
    got = {r.interval: r for r in L.train_log_intervals(df, logging_steps=10, grad_accum=8, batch_size=2).collect()}
    assert sorted(got) == [1, 2, 3]
    assert got[3].log_step == 25 and got[3].n_steps == 5
    assert got[3].loss_ref == pytest.approx(5 * 0.5 * 8 / 10)  # short window still divided by 10
    assert got[1].loss_mean == pytest.approx(0.5)
    assert got[2].samples_per_sec == pytest.approx(20 * 16 / 19.0)


def ckpt_df(spark, values):
    rows = [("r", i + 1, None if v == "missing" else {"eval_loss": v}) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run string, step bigint, metrics map<string,double>")


def test_running_best_edges(spark):
    vals = [INF, 3.0, NAN, "missing", 3.0, 2.0, -INF]
    got = RU.running_best(ckpt_df(spark, vals)).orderBy("step").collect()
    assert [r.is_best for r in got] == [False, True, False, False, False, True, True]
    assert [r.best_metric_value for r in got] == [INF, 3.0, 3.0, 3.0, 3.0, 2.0, -INF]
    mx = RU.running_best(ckpt_df(spark, [1.0, 0.5, 2.0]), mode="max").orderBy("step").collect()
    assert [r.is_best for r in mx] == [True, False, True]
    with pytest.raises(ValueError):
        RU.running_best(ckpt_df(spark, [1.0]), mode="median")


def test_retention_keeps_newest_and_best(spark):
    b = RU.running_best(ckpt_df(spark, [1.0, 5.0, 6.0, 7.0, 8.0]))
    got = {r.step: r.action for r in RU.checkpoint_retention(b, max_to_keep=3).collect()}
    assert got == {1: "keep", 2: "purge", 3: "keep", 4: "keep", 5: "keep"}


def test_latency_and_speedup(spark):
    rows = [(v, i + 1, float(ms), 10.0 * (v == "a")) for v in "ab" for i, ms in enumerate([100, 100, 5, 6, 7, 8, 9])]
    df = spark.createDataFrame(rows, "variant string, seq int, elapsed_ms double, peak_mb double")
    stats = RU.latency_percentiles(RU.skip_warmup(df, "variant", "seq", 2))
    for r in stats.collect():
        assert r.n == 5 and r.p50_latency_ms <= r.p90_latency_ms <= r.p99_latency_ms
        assert r.mean_latency_ms == pytest.approx(7.0)
    sp = RU.variant_speedup(stats, "a", "b").first()
    assert sp.speedup_factor == pytest.approx(1.0) and sp.vram_saved_mb == pytest.approx(10.0)


def test_throughput_guards(spark):
    df = spark.createDataFrame([("v", 1, 0, 0.0), ("w", 1, 10, 2.0)], "variant string, sample int, tokens bigint, seconds double")
    got = {r.variant: r for r in RU.generation_throughput(df).collect()}
    assert got["v"].tokens_per_second == 0.0 and got["v"].latency_per_token_ms == 0.0
    assert got["w"].tokens_per_second == 5.0 and got["w"].latency_per_token_ms == 200.0


def test_memory_formulas(spark):
    import datetime as dt
    df = spark.createDataFrame([(0, dt.datetime(2024, 1, 1), 1, 3.0, 4.0, 3.0, 10.0),
                                (0, dt.datetime(2024, 1, 2), 2, 1.0, 1.5, 1.0, 10.0)],
                               "device int, ts timestamp, event_id bigint, allocated double, reserved double, "
                               "max_allocated double, total double")
    r = RU.memory_telemetry(df).orderBy("event_id").collect()
    assert r[0].free_gb == 6.0 and r[0].fragmentation_pct == 25.0 and r[0].freed_gb is None
    assert r[1].freed_gb == 2.5


def test_perplexity_of_a_missing_loss(spark):
    from tunelake.operators.losses import perplexity
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (1.0,), (500.0,)], "x double")
    got = [r.p for r in df.select(perplexity(F.col("x")).alias("p")).collect()]
    assert got[:3] == [None, None, 1.0] and got[3] == pytest.approx(2.718281828) and got[4] == pytest.approx(2.6881e43, rel=1e-4)
