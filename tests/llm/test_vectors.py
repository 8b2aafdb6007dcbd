"""Whitening and hard negatives against direct computation."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.llm import bond_negatives as B
from tunelake.llm import qd_solver as Q
from tunelake.llm import queries
from tunelake.llm import whitening as W

SMALL = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, blob string, rank int, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, lab, "x", 7, 9) for i, v, lab in rows], SCHEMA).repartition(parts)


def odd_vectors(seed=0, n=60, d=6):
    """Ties, copies, nulls in every column, non-finite entries, a short vector, a hot label."""
    rng = random.Random(seed)
    rows = [(i, [round(rng.gauss(0, 1), 2) for _ in range(d)], rng.choice([0, 0, 0, 1, 2, 9])) for i in range(n)]
    rows += [(n + i, rows[0][1], rows[0][2]) for i in range(9)]                  # copies of an anchor
    rows += [(100 + i, rows[i][1], 1) for i in range(8)]
    rows += [(200, None, 1), (201, [1.0, None] + [0.0] * (d - 2), 1), (202, [math.nan] * d, 2), (203, [math.inf] * d, 2),
             (300, rows[5][1], None), (None, rows[3][1], 0), (None, None, None), (0, rows[0][1], rows[0][2]),
             (7, rows[1][1], 2), (400, [0.5, 0.25], 0), (500, [0.0] * d, 0), (500, [0.0] * d, 0)]
    return rows


def finite(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


# --- the solver --------------------------------------------------------------------

def matrices():
    rng = np.random.default_rng(3)
    turn = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    yield rng.normal(size=(300, 64))
    yield np.eye(12)
    yield np.diag([3.0, 3, 3, 1, 1, 1, 1, 1, 1, 1])
    yield rng.normal(size=(100, 3)) @ rng.normal(size=(3, 20))
    yield rng.normal(size=(200, 30)) * 10.0 ** -np.arange(30)
    for values in (np.r_[np.full(20, 5.0), np.ones(20)], 1 + 1e-9 * rng.normal(size=40), np.r_[1e6, 1e6 + 1e-3, np.ones(38)],
                   np.r_[np.ones(39), 0.0]):
        yield np.diag(values) @ turn
    for _ in range(40):
        n = int(rng.integers(1, 20))
        yield np.vstack([rng.integers(-2, 3, size=(int(rng.integers(1, 40)), n)).astype(float), np.zeros((n, n))])


def test_solver_against_numpy():
    for m in matrices():
        r = np.linalg.qr(np.vstack([m, np.zeros((m.shape[1],) * 2)]))[1]
        values, vectors = Q.principal(r, 8)
        want = np.linalg.svd(r, compute_uv=False) ** 2
        top = max(want[0], 1e-300)
        assert np.abs(values - want).max() <= 1e-13 * top
        k = vectors.shape[1]
        assert k == min(8, np.linalg.matrix_rank(m))
        if k:
            assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-11
            assert np.abs(r.T @ (r @ vectors) - vectors * values[:k]).max() < 1e-11 * top


def test_small_values_keep_relative_accuracy():
    """A graded bidiagonal matrix, whose values the plain eigenvalues of B'B lose, against 60 digits."""
    from decimal import Decimal, getcontext
    getcontext().prec = 60
    n = 12
    diagonal, above = np.array([10.0 ** -(2 * i) for i in range(n)]), np.array([0.5 * 10.0 ** -(2 * i + 1) for i in range(n - 1)])
    got = Q.dqds(diagonal, above)
    product = Decimal(1)
    for v in got:
        product *= Decimal(float(v))
    want = Decimal(1)
    for v in diagonal:
        want *= Decimal(float(v)) ** 2
    assert abs(product / want - 1) < Decimal("1e-12")  # determinant: wrong if a single small value is

    def negatives(x):  # Sturm count of B'B - x in 60 digits
        a, b, count, p = [Decimal(float(v)) for v in diagonal], [Decimal(float(v)) for v in above], 0, None
        for i in range(n):
            t = a[i] ** 2 + (b[i - 1] ** 2 if i else 0) - x
            p = t if i == 0 else t - (a[i - 1] * b[i - 1]) ** 2 / p
            count += p < 0
        return count
    for i, v in enumerate(got):
        x = Decimal(float(v))
        assert negatives(x * (1 - Decimal("1e-12"))) <= n - 1 - i < negatives(x * (1 + Decimal("1e-12")))


# --- whitening ---------------------------------------------------------------------

def check_whitening(rows, got, components=8):
    kept = [(i, [math.floor(1024 * x) + 100000 for x in v]) for i, v, _ in rows if finite(v)]
    d = max((len(x) for _, x in kept), default=0)
    x = np.array([v + [100000] * (d - len(v)) for _, v in kept], float)
    n = len(x)
    exact = [[int(v) for v in r] for r in x]
    sums = [sum(r[j] for r in exact) for j in range(d)]
    dev = [sum((n * r[j] - sums[j]) ** 2 for j in range(d)) for r in exact]
    c = x - np.array(sums) / n
    cov = c.T @ c / n
    e = np.linalg.eigvalsh(cov)[::-1]
    k = min(components, np.linalg.matrix_rank(c))
    assert len(got) == n * k and all(r["n"] == n for r in got)
    assert sorted((str(r["vec_id"]), r["component"], r["deviation"]) for r in got) == sorted(
        (str(i), j + 1, dev[a]) for a, (i, _) in enumerate(kept) for j in range(k))
    for j in range(k):
        of = [r for r in got if r["component"] == j + 1]
        assert abs(of[0]["explained"] / (e[j] / np.trace(cov)) - 1) < 1e-9
        y = np.array([r["whitened"] for r in of])
        assert abs(y.mean()) < 1e-8 and abs((y ** 2).mean() - 1) < 1e-8
    assert all(r["identity_error"] < 1e-8 for r in got)


def test_whitening_odd_rows(spark):
    rows = odd_vectors()
    check_whitening(rows, W.whitened(frame(spark, rows)).collect())


def test_whitening_directions(spark):
    """Whitened entries are the projections on numpy's eigenvectors, up to one sign for each component."""
    rng = np.random.default_rng(1)
    data = rng.normal(size=(80, 5)) * [5, 3, 2, 1, 0.5]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(data)]
    got = {(r["vec_id"], r["component"]): r["whitened"] for r in W.whitened(frame(spark, rows), components=3).collect()}
    x = np.floor(1024 * data) + 100000
    c = x - x.mean(axis=0)
    e, v = np.linalg.eigh(c.T @ c / len(x))
    want = (c @ v / np.sqrt(e))[:, ::-1][:, :3]
    for j in range(3):
        mine = np.array([got[i, j + 1] for i in range(80)])
        assert min(np.abs(mine - want[:, j]).max(), np.abs(mine + want[:, j]).max()) < 1e-9


def test_whitening_small_tables(spark):
    assert W.whitened(frame(spark, [])).collect() == []
    assert W.whitened(frame(spark, [(1, None, 0), (2, [math.nan], 0)])).collect() == []
    assert W.whitened(frame(spark, [(1, [1.0, 2.0], 0)])).collect() == []          # a single row has no deviation
    assert W.whitened(frame(spark, [(1, [], 0), (2, [], 0)])).collect() == []
    check_whitening([(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0), (2, [1.0, 3.0], 0)],
                    W.whitened(frame(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 3.0], 0), (2, [1.0, 3.0], 0)])).collect())


def test_whitening_does_not_depend_on_partitions(spark):
    rows = odd_vectors(4)
    a, b = ({(str(r["vec_id"]), r["component"], r["deviation"]): abs(r["whitened"])
             for r in W.whitened(frame(spark, rows, p)).collect()} for p in (1, 7))
    assert a.keys() == b.keys() and all(abs(a[k] - b[k]) < 1e-8 for k in a)


def test_wide_entries():
    x = np.array([[2 ** 40, 0], [0, 2 ** 40]])
    with pytest.raises(OverflowError):
        W._deviation(x, 1 << 20, x.sum(axis=0))
    small = np.array([[100_123, 99_000], [100_000, 101_000]])
    s = small.sum(axis=0)
    assert W._deviation(small, 2, s).tolist() == [sum((2 * int(v) - int(t)) ** 2 for v, t in zip(r, s)) for r in small]
    with pytest.raises(OverflowError):
        W.integers(np.array([[1e300]]), 1, 1024, 0)


def test_op12_whole_table(spark):
    got = queries.op12_qd_whitening(spark, SMALL).collect()
    rows = [(r["vec_id"], r["embedding"], 0) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    check_whitening(rows, got)


# --- hard negatives ----------------------------------------------------------------

def brute_negatives(rows, anchor, k=5, num=80, den=100):
    live = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if lab is not None and finite(v)]

    def score(a, b):
        return sum(x * y for x, y in zip(a, b))

    def place(s, i):
        return (-s, i is None, i or 0)
    out = []
    for at, (i, v, lab) in enumerate(live):
        if not anchor(i):
            continue
        same = sorted((place(score(v, w), j) + (j,) for b, (j, w, m) in enumerate(live) if b != at and m == lab))[:k]
        other = sorted((place(score(v, w), j) + (j,) for j, w, m in live if m != lab))
        for s, _, _, p in same:
            good = [(o[3], -o[0]) for o in other if num * -s <= den * -o[0] <= den * -s][:k]
            out += [(i, p, r + 1, j, -s, t) for r, (j, t) in enumerate(good)]
    return sorted(out, key=str)


def mined(df, **kw):
    got = B.hard_negatives(df, F.col("vec_id") % 100 == 0, **kw).collect()
    return sorted(((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                   for r in got), key=str)


def is_anchor(i):
    return i is not None and i % 100 == 0


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_negatives_against_brute_force(spark, seed, monkeypatch):
    if seed == 1:
        monkeypatch.setattr(B, "PART_BYTES", 300)  # many parts and groups
    rows = odd_vectors(seed)
    want = brute_negatives(rows, is_anchor)
    assert want and mined(frame(spark, rows)) == want


def test_negatives_other_windows(spark):
    rows = odd_vectors(5)
    assert mined(frame(spark, rows), num=0, positives=3, negatives=2) == [
        r for r in brute_negatives(rows, is_anchor, 3, num=0) if r[2] <= 2]


def test_negatives_exact_beyond_doubles(spark):
    rng = random.Random(2)
    rows = [(i * 50, [float(rng.randrange(1 << 20)) for _ in range(4)], i % 2) for i in range(20)]
    rows = [(i, [x / 256 + 4e6 for x in v], lab) for i, v, lab in rows]  # products near 2^60: no double holds their sums
    assert mined(frame(spark, rows)) == brute_negatives(rows, is_anchor)


def test_negatives_small_tables(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, [(100, [1.0], 1)])) == []                              # alone
    assert mined(frame(spark, [(1, [1.0], 1), (2, [1.0], 2)])) == []                 # no anchor
    assert mined(frame(spark, [(0, [1.0], 1), (1, [1.0], 1), (2, [0.9], None)])) == []
    rows = [(0, [1.0], 1), (0, [1.0], 1), (5, [0.9], 2), (None, [1.0], 2)]
    assert mined(frame(spark, rows)) == brute_negatives(rows, is_anchor)
    assert mined(frame(spark, [(0, [], 1), (1, [], 1), (2, [], 2)])) == brute_negatives(
        [(0, [], 1), (1, [], 1), (2, [], 2)], is_anchor)


def test_bitmap_shrinks():
    """Most rows leave before their last dimension, and none of the best does."""
    rng = np.random.default_rng(0)
    a = (rng.normal(size=64) * 2.0 ** -np.arange(64) * 4096).astype(np.float64).round()
    x = rng.integers(-100, 100, size=(64, 500)).astype(np.float64)
    exact, alive = a @ x, []

    def keep(partial, low, high):
        alive.append(len(partial))
        return partial + high >= np.sort(partial + low)[-5]
    rows, scores = B.Scan(x).scores(a, np.arange(500), keep)
    assert set(np.argsort(-exact)[:5]) <= set(rows.tolist()) and (scores == exact[rows]).all()
    assert alive[-1] < 50 < alive[0]


def test_op13_whole_table(spark):
    rows = [(r["vec_id"], r["embedding"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0
             else r["label"]) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = sorted(((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
                  for r in queries.op13_bond_negatives(spark, SMALL).collect()), key=str)
    assert got == brute_negatives(rows, is_anchor)
