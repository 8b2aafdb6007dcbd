import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tunelake.functions.lcs import lcs_len
from tunelake.functions.text import bleu_tokens, ngrams
from tunelake.operators import textmetrics as TM


def dp_lcs(a, b):
    m, n = len(a), len(b)
    dp = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            dp[i][j] = dp[i - 1][j - 1] + 1 if a[i - 1] == b[j - 1] else max(dp[i - 1][j], dp[i][j - 1])
    return dp[m][n]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abcde"), max_size=90), st.lists(st.sampled_from("abcde"), max_size=90))
def test_bit_parallel_lcs_equals_dp(a, b):
    assert lcs_len(a, b) == dp_lcs(a, b)


ROUGE_CASES = [
    ("rivers run down to cold seas", "rivers run down to cold seas", 1.0),
    ("", "rivers run", 0.0),
    ("rivers run", "", 0.0),
    ("one two", "three four five", 0.0),
    ("rivers down seas tide", "rivers run down to cold seas", 2 * 0.75 * 0.5 / 1.25),
]


def test_lcs_and_rouge_l_cases(spark):
    rows = [(i, p, r) for i, (p, r, _) in enumerate(ROUGE_CASES)] + [(99, "red boat sails north today", "red kite sails today")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    got = {r.id: r for r in TM.with_rouge_l(df).collect()}
    assert got[99].lcs == 3
    for i, (_, _, want) in enumerate(ROUGE_CASES):
        assert got[i].rouge_l == pytest.approx(want)


def test_fallback_metrics(spark):
    df = spark.createDataFrame([(1, "rivers run down", "rivers run down"),
                                (2, "old boats sail east", "boats sail far away")],
                               "id int, prediction string, reference string")
    m = TM.generation_metrics_fallback(TM.with_rouge_l(df)).first()
    assert (m.rouge1, m.rouge2, m.rougeL, m.bleu) == (75.0, 75.0, 75.0, 0.0)
    empty = TM.generation_metrics_fallback(TM.with_rouge_l(df.limit(0))).first()
    assert (empty.rouge1, empty.bleu) == (0.0, 0.0)
    mism = spark.createDataFrame([(1, "a b", "a b"), (2, "c", None)], "id int, prediction string, reference string")
    assert TM.generation_metrics_fallback(TM.with_rouge_l(mism)).first().rougeL == 0.0


def test_ngrams_short_arrays(spark):
    df = spark.createDataFrame([(["a"],), ([],), (["a", "b", "c"],)], "t array<string>")
    assert [r.g for r in df.select(ngrams(F.col("t"), 2).alias("g")).collect()] == [[], [], ["a b", "b c"]]


def py_rouge_n(p, r, n):
    def toks(s):
        import re
        return re.findall(r"[a-z0-9]+", s.lower())
    pg = Counter(tuple(toks(p)[i:i + n]) for i in range(len(toks(p)) - n + 1))
    rg = Counter(tuple(toks(r)[i:i + n]) for i in range(len(toks(r)) - n + 1))
    ov = sum((pg & rg).values())
    prec, rec = ov / max(sum(pg.values()), 1), ov / max(sum(rg.values()), 1)
    return 0.0 if prec + rec == 0 else 2 * prec * rec / (prec + rec)


def test_rouge_n_clipping_case_and_punctuation(spark):
    rows = [(1, "The the THE cat!", "the cat cat, the"), (2, "Ünïcode über", "uber ber"), (3, "a", "a b c")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    got = {r.id: r for r in TM.rouge_n(df, "id", orders=(1, 2)).collect()}
    for i, p, r in rows:
        assert got[i].rouge1 == pytest.approx(py_rouge_n(p, r, 1))
        assert got[i].rouge2 == pytest.approx(py_rouge_n(p, r, 2))


def test_bleu_13a_tokens(spark):
    df = spark.createDataFrame([("Hello, world. It costs $3.50-4 (approx).",)], "s string")
    toks = df.select(bleu_tokens(F.col("s")).alias("t")).first().t
    assert toks == ["Hello", ",", "world", ".", "It", "costs", "$", "3.50", "-", "4", "(", "approx", ")", "."]


def test_bleu_corpus_matches_formula(spark):
    rows = [(1, "the cat is on the mat", "the cat is on the mat"),
            (2, "there is a cat on the mat", "a cat is on the mat")]
    df = spark.createDataFrame(rows, "id int, prediction string, reference string")
    b = TM.bleu_corpus(df, "id").first()
    # by hand: clipped matches and possible n-grams summed over both sentences
    matches, possible = [12, 8, 5, 3], [13, 11, 9, 7]
    geo = math.exp(sum(math.log(m / p) for m, p in zip(matches, possible)) / 4)
    assert b.bleu == pytest.approx(geo * 1.0)  # 13 > 12 tokens: no brevity penalty
    assert [b.matches_1, b.matches_2, b.matches_3, b.matches_4] == matches


def test_rows_with_one_id_stay_apart(spark):
    df = spark.createDataFrame([(1, "a b", "a b"), (1, "c d", "c d")], "id int, prediction string, reference string")
    assert [r.rouge1 for r in TM.rouge_n(df, "id").collect()] == [1.0, 1.0]
    assert TM.bleu_corpus(df, "id", max_order=2).first().bleu == pytest.approx(1.0)
