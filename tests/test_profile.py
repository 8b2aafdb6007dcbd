import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.operators import profile as A
from tunelake.sources.writers import render_eda_markdown, write_summary_json


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(7)
    xs = rng.integers(1, 500, 1001).tolist()
    df = spark.createDataFrame([(int(x),) for x in xs], "n bigint")
    r = A.length_quantiles(df, measures=("n",)).first()
    arr = np.array(xs)
    for q, name in ((50, "p50"), (90, "p90"), (95, "p95"), (99, "p99")):
        assert r[name] == pytest.approx(float(np.percentile(arr, q)))
    assert r.max_len == arr.max() and r.min_len == arr.min()
    assert r.mean == pytest.approx(arr.mean())
    assert r.std_dev == pytest.approx(arr.std())


@pytest.mark.parametrize("values,bins", [([1, 2, 2, 3, 10, 10, 7], 5), ([4, 4, 4], 3), ([0.5, -1.25, 3.0, 2.0], 4)])
def test_histogram_matches_numpy(spark, values, bins):
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    got = A.histogram(df, "v", bins).orderBy("bin").collect()
    counts, edges = np.histogram(np.array(values, dtype=float), bins=bins)
    assert [r["count"] for r in got] == counts.tolist()
    assert [r.bin_lo for r in got] == pytest.approx(edges[:-1].tolist())
    assert got[-1].bin_hi == pytest.approx(edges[-1])


def test_null_profile_and_status(spark):
    df = spark.createDataFrame([("a", None), (None, None), ("b", "c")], "prompt string, response string")
    got = {r.feature: (r.null_count, r.status) for r in A.null_profile(df).collect()}
    assert got == {"prompt": (1, "WARNING (1 nulls)"), "response": (2, "WARNING (2 nulls)")}


def test_eda_summary_counts_before_drop_and_reports(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, "a b c", "d e"), (2, None, "x"), (3, "p", "q r s t")],
                               "conv_id bigint, prompt string, response string")
    s = A.eda_summary(df, "demo")
    row = s.first()
    assert row.total_samples == 3
    assert row.missing_value_counts == {"conv_id": 0, "prompt": 1, "response": 0}
    assert row.prompt_length_quantiles.max_len == 3 and row.prompt_length_quantiles.min_len == 1
    assert row.total_sequence_quantiles.p50 == pytest.approx(np.percentile([5, 5], 50))
    assert row.recommended_max_seq_length == 2048
    md = render_eda_markdown(row)
    assert "| prompt | 1 | has gaps |" in md and "2048" in md
    write_summary_json(s, f"{tmpdir_fresh}/summary")
    back = spark.read.json(f"{tmpdir_fresh}/summary").first()
    assert back.total_samples == 3


def test_recommended_length_threshold(spark):
    df = spark.createDataFrame([(2048.0,), (2049.0,)], "p double")
    got = [r.r for r in df.select(A.recommended_length(F.col("p")).alias("r")).collect()]
    assert got == [2048, 4096]


def test_empty_input_gives_null_statistics(spark):
    df = spark.createDataFrame([], "prompt string, response string")
    row = A.eda_summary(df, "empty").first()
    assert row.total_samples == 0 and row.total_sequence_quantiles.p50 is None


def test_summary_json_roundtrip_types(spark, tmpdir_fresh):
    df = spark.createDataFrame([(1, "a", "b")], "conv_id bigint, prompt string, response string")
    write_summary_json(A.eda_summary(df, "x"), f"{tmpdir_fresh}/j")
    import glob
    text = open(glob.glob(f"{tmpdir_fresh}/j/*.json")[0]).read()
    assert json.loads(text)["missing_value_counts"]["prompt"] == 0


def test_exact_quantiles_match_numpy_with_ties_and_hot_group(spark):
    rng = np.random.default_rng(11)
    rows = [("hot", float(x)) for x in rng.normal(size=900).round(1)] + \
           [("cold", float(x)) for x in rng.normal(size=7)] + [("one", 5.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in A.quantiles_by_rank(df, "v", (0.25, 0.5, 0.9, 0.99), ["g"]).collect()}
    for g in ("hot", "cold", "one"):
        arr = np.array([v for k, v in rows if k == g])
        for q, name in ((25, "q25"), (50, "q50"), (90, "q90"), (99, "q99")):
            assert got[g][name] == pytest.approx(float(np.percentile(arr, q)), abs=1e-12)
    whole = A.quantiles_by_rank(df, "v", (0.5,)).first()
    assert whole.q50 == pytest.approx(float(np.percentile([v for _, v in rows], 50)))


def test_approx_quantiles_rank_error(spark):
    rng = np.random.default_rng(5)
    xs = rng.integers(0, 100000, 20000)
    df = spark.createDataFrame([(int(x),) for x in xs], "n bigint")
    r = A.length_quantiles(df, measures=("n",), approx=True).first()
    srt = np.sort(xs)
    for q, name in ((0.5, "p50"), (0.9, "p90"), (0.99, "p99")):
        rank = np.searchsorted(srt, r[name], side="right") / len(srt)
        assert abs(rank - q) <= 1.0 / 10000 + 1e-3  # accuracy 10000 -> relative rank error ~1e-4
