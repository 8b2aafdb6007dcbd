import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.operators import scoring as SC


def test_delta_weight_formula():
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(4, 8)), rng.normal(size=(12, 4))
    np.testing.assert_allclose(SC.delta_weight(a, b, 4, 16), (16 / 4) * b @ a, atol=1e-5)
    np.testing.assert_allclose(SC.delta_weight(a, b, 0, 16), b @ a, atol=1e-5)


def test_projection_parity(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(6, 32))
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id int, v array<double>")
    W, A, B = rng.normal(size=(16, 32)), rng.normal(size=(8, 32)), rng.normal(size=(16, 8))
    p = SC.low_rank_projection(df, "v", ["id"], W, A, B, 8, 16)
    rows = {r.id: r for r in p.collect()}
    want = x @ (W + 2.0 * B @ A).T
    for i in range(6):
        np.testing.assert_allclose(rows[i].fused, want[i], atol=1e-9)
    assert all(r.parity_ok for r in SC.projection_parity(p, ["id"]).collect())


def test_tokenizer_and_model_callables(spark):
    df = spark.createDataFrame([(1, "Hello, world!", "world"), (2, "a b c", "x y")],
                               "id int, prompt string, reference string")
    n = {r.id: r.n for r in df.select("id", SC.tokenizer_lengths(F.col("prompt"), SC.word_punct_tokenizer).alias("n")).collect()}
    assert n == {1: 4, 2: 3}
    s = {r.id: r for r in SC.score_with_model(df, lambda: SC.echo_model(2), keep=["id"]).collect()}
    assert s[1].prediction == "Hello, world!" and s[2].prediction == "a b"
    assert s[2].loss == pytest.approx(np.log1p(1.0)) and s[2].num_tokens == 2


def test_two_tokenizers_in_one_query(spark):
    df = spark.createDataFrame([("ab cd",)], "t string")
    row = df.select(SC.tokenizer_lengths(F.col("t"), lambda: str.split).alias("w"),
                    SC.tokenizer_lengths(F.col("t"), lambda: list).alias("c")).first()
    assert (row.w, row.c) == (2, 5)
