"""Exact signed ranks with ties, bootstrap intervals, mergeable sketches."""

import hashlib
import itertools
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.functions.stats import signed_rank_cdf, tied_rank_cdf, wilcoxon_p
from tunelake.operators import hypothesis as H
from tunelake.operators import sketches as K
from tunelake.operators import textmetrics as TM


def mid_ranks(values):
    a = [abs(v) for v in values]
    return [sum(x < v for x in a) + (sum(x == v for x in a) + 1) / 2 for v in a]


def enumerated_p(values):
    """Two-sided p over all sign patterns of the non-zero differences."""
    d = [v for v in values if v]
    ranks = mid_ranks(d)
    w = min(sum(r for r, v in zip(ranks, d) if v > 0), sum(r for r, v in zip(ranks, d) if v < 0))
    hits = sum(sum(r for r, s in zip(ranks, signs) if s) <= w + 1e-9 for signs in itertools.product((0, 1), repeat=len(d)))
    return w, min(1.0, 2.0 * hits / 2 ** len(d))


def tie_pattern(values):
    a = [abs(v) for v in values if v]
    return tuple(a.count(x) for x in sorted(set(a)))


@pytest.mark.parametrize("seed", range(30))
def test_exact_p_with_ties_and_zeros_by_enumeration(seed):
    rng = random.Random(seed)
    values = [rng.choice([-3, -2, -1, 0, 1, 2, 3, 4]) for _ in range(rng.randint(1, 12))]
    d = [v for v in values if v]
    if not d:
        return
    w, p = enumerated_p(values)
    got = wilcoxon_p(w, len(d), None, len(values) - len(d), True, "exact", tie_pattern(values))
    assert got == (pytest.approx(p, abs=1e-15), "exact")


def test_exact_table_without_ties_is_the_plain_one():
    for n in (1, 5, 20, 50):
        for w in (0, 1, 7, n * (n + 1) / 4):
            assert tied_rank_cdf(w, (1,) * n) == signed_rank_cdf(w, n)


def test_large_samples_fall_back():
    assert wilcoxon_p(100.0, 60, 0.0, 0, True, "exact", (1,) * 50)[1] == "approx"
    assert wilcoxon_p(5.0, 6, 0.0, 0, False, "exact", None)[1] == "exact"


def test_report_with_ties(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for g in range(12):
        d = [rng.choice([-2, -1, 0, 1, 2, 3]) for _ in range(rng.randint(3, 12))]
        rows += [(g, i, 10.0, 10.0 + v) for i, v in enumerate(d)]
        want[g] = enumerated_p(d) if any(d) else (0.0, 1.0)
    rows += [(99, i, 0.0, float(i % 5 + 1)) for i in range(200)]       # too many for the exact table
    df = spark.createDataFrame(rows, "group_id long, sample_id long, base double, fused double").repartition(3)
    got = {r.group_id: r for r in H.significance_report(df, ["group_id"], method="exact").collect()}
    for g, (w, p) in want.items():
        assert got[g].wilcoxon_statistic == w and got[g].wilcoxon_p_value == pytest.approx(p, abs=1e-12)
    assert got[99].wilcoxon_method == "approx"


# --- bootstrap ----------------------------------------------------------------------

def test_poisson_weights(spark):
    """The shares of the weights are those of the distribution."""
    w = spark.range(40000).select(TM.poisson_weight(F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 8), 16, 10)
                                                    .cast("long")).alias("w")).groupBy("w").count().collect()
    share = {r.w: r["count"] / 40000 for r in w}
    for k in range(5):
        assert share[k] == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.01)


def test_bootstrap_against_a_loop(spark):
    rng = random.Random(1)
    rows = [(i % 50, rng.random(), rng.choice([None, 0.0, 1.0])) for i in range(60)]     # repeated ids share their weights
    df = spark.createDataFrame(rows, "id long, a double, b double")

    def weight(i, r):
        h = int(hashlib.md5(f"7:{i}:{r // 4}".encode()).hexdigest()[8 * (r % 4):8 * (r % 4) + 8], 16)
        return sum(h >= int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2 ** 32) for k in range(9))
    got = [{r.metric: (r.low, r.mid, r.high) for r in
            TM.bootstrap_interval(df.repartition(p), "id", ["a", "b"], replicates=22, seed=7, level=0.8).collect()} for p in (1, 6)]
    for m, at in (("a", 1), ("b", 2)):
        means = []
        for r in range(22):
            w = [(weight(row[0], r), row[at]) for row in rows if row[at] is not None]
            means.append(sum(x * v for x, v in w) / sum(x for x, _ in w))
        want = np.quantile(means, [0.1, 0.5, 0.9])
        for g in got:
            assert g[m] == pytest.approx(tuple(want), rel=1e-12)


# --- sketches -----------------------------------------------------------------------

def test_merged_sketches_keep_their_bound(spark, tmpdir_fresh):
    rng = random.Random(5)
    rows = [(g, day, int(rng.lognormvariate(4, 1))) for g in ("a", "b") for day in range(12) for _ in range(900)]
    rows += [("a", 1, None), ("tiny", 0, 7)]
    df = spark.createDataFrame(rows, "g string, day int, v long").repartition(5)
    table = f"{tmpdir_fresh}/sketches"
    for first, last in ((0, 5), (6, 11)):                    # later days are appended
        K.build_sketches(df.where(F.col("day").between(first, last)), "v", ["g", "day"]).write.mode("append").parquet(table)
    merged = K.merge_sketches(spark.read.parquet(table), ["g"])
    qs = (0.01, 0.5, 0.9, 0.99)
    errors = K.rank_errors(K.sketch_quantiles(merged, qs, ["g"]), df, "v", ["g"]).collect()
    assert {(r.g, r.q) for r in errors} == {(g, q) for g in ("a", "b", "tiny") for q in qs}
    for r in errors:
        assert r.n == (1 if r.g == "tiny" else 10800) and r.rank_error <= K.RANK_ERROR
        values = [v for g, _, v in rows if g == r.g and v is not None]
        assert r.rank_below == sum(v < r.estimate for v in values) / len(values)
        assert r.rank_upto == sum(v <= r.estimate for v in values) / len(values)


def test_many_exact_comparisons_with_ties():
    """Fifty values cost a part of a millisecond; lists of sums took several."""
    rng = random.Random(5)

    def by_lists(w, ties):
        counts, below = [1], 0
        for t in ties:
            doubled = 2 * below + t + 1
            below += t
            for _ in range(t):
                counts = [(counts[s] if s < len(counts) else 0) + (counts[s - doubled] if s >= doubled else 0)
                          for s in range(len(counts) + doubled)]
        return sum(counts[:math.floor(2 * w + 1e-9) + 1]) / 2 ** sum(ties)
    cases = []
    for _ in range(2000):
        ties = []
        while sum(ties) < 50:
            ties.append(min(rng.randint(1, 4), 50 - sum(ties)))
        cases.append((rng.randint(0, 1275) / 2, tuple(ties)))
    begin = time.process_time()
    got = [tied_rank_cdf(*c) for c in cases]
    assert time.process_time() - begin < 4
    assert got[:20] == [by_lists(*c) for c in cases[:20]]
    for w, ties in [(-1, (2, 1)), (0, (1,)), (1.5, (2,)), (3, (2,)), (99, (3, 2)), (900, (40, 30))]:
        assert tied_rank_cdf(w, ties) == (by_lists(w, ties) if w >= 0 else 0.0)
