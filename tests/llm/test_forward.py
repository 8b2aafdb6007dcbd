"""The classifiers' scores from their formulas, row by row and pair by pair."""

import math
import random

import numpy as np

from tunelake.llm import passage_quality as Q
from tunelake.llm import toxicity as T


def test_machine_margins_over_all_pairs():
    rng = np.random.default_rng(4)
    n = 40
    m = T.Machine(np.sort(rng.choice(1000, n, replace=False)), 0.3, rng.normal(size=n), rng.normal(size=(n, T.FACTORS)))
    rows = [np.sort(rng.choice(n, k, replace=False)) for k in (0, 1, 2, 7, 40)] + [np.zeros(0, np.int64)]
    for row, got in zip(rows, m.margins(rows)):
        want = m.bias + sum(m.weights[i] for i in row)
        want += sum(float(m.factors[i] @ m.factors[j]) for a, i in enumerate(row) for j in row[:a])
        assert abs(got - want) < 1e-9
    known = set(m.buckets.tolist())
    some = np.arange(0, 1000, 3)
    assert [int(m.buckets[p]) for p in m.position(some)] == [b for b in some.tolist() if b in known]


def passage_by_hand(words):
    p = [w.decode() for w in words]
    raw = " ".join(p)
    n, size = len(p), max(1, len(raw.encode()))
    return n, size, len(set(p)) / n, sum(a == b for a, b in zip(p, p[1:])) / n


def test_passages_by_hand():
    rng = random.Random(2)
    text = " ".join(rng.choice(["the", "the", "Wort,", "12%", "a|b", "end.", "###"]) for _ in range(3 * Q.PASSAGE + 5))
    got = Q.passage_features(text)
    words = text.encode().split()
    assert len(got) == 4
    for k, row in enumerate(got):
        p = words[k * Q.PASSAGE:(k + 1) * Q.PASSAGE]
        n, size, kinds, repeats = passage_by_hand(p)
        assert abs(row[0] - math.log1p(n)) < 1e-12 and abs(row[1] - (size - n + 1) / n) < 1e-12
        assert abs(row[2] - kinds) < 1e-12 and abs(row[3] - repeats) < 1e-12
        assert abs(row[12] - max(map(len, p)) / 64) < 1e-12 and row[13] == 1.0


def by_hand(net, bag):
    """Attention and score of one document, in plain Python."""
    p = {k: v.tolist() for k, v in net.p.items()}

    def times(x, m):
        return [sum(a * row[j] for a, row in zip(x, m)) for j in range(len(m[0]))]
    hidden, energy = [], []
    for row in bag:
        x = [(a - m) / s for a, m, s in zip(row, net.mean, net.scale)]
        h = [math.tanh(a + b) for a, b in zip(times(x, p["W"]), p["b"])]
        gate = [math.tanh(a) / (1 + math.exp(-b)) for a, b in zip(times(h, p["V"]), times(h, p["U"]))]
        hidden.append(h)
        energy.append(sum(a * g for a, g in zip(p["a"], gate)))
    top = max(energy)
    e = [math.exp(v - top) for v in energy]
    z = [sum(w * h[j] for w, h in zip(e, hidden)) / sum(e) for j in range(Q.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(z, p["c"])) + p["d"][0])))


def test_network_scores_by_hand():
    rng = np.random.default_rng(1)
    net = Q.Network(rng.normal(size=Q.FEATURES), 1 + rng.random(Q.FEATURES), {k: rng.normal(0, 0.5, s) for k, s in Q.SHAPES.items()})
    texts = ["", "one", " ".join(["word", "Other.", "x1"] * 90), "a " * 500, "%%% ### | 12 12 12"]
    got = Q.scores(net, texts)
    for t, y in zip(texts, got):
        assert abs(y - by_hand(net, Q.passage_features(t))) < 1e-12
    f = net.forward(Q.passage_features(texts[2]), np.zeros(1, np.int64), np.array([len(Q.passage_features(texts[2]))]))
    assert abs(f["weight"].sum() - 1) < 1e-12 and (f["weight"] > 0).all()


def test_gradients_by_differences():
    """Every parameter's gradient against differences of the loss of the plain forward pass."""
    rng = np.random.default_rng(3)
    net = Q.Network(np.zeros(Q.FEATURES), np.ones(Q.FEATURES), {k: rng.normal(0, 0.3, s) for k, s in Q.SHAPES.items()})
    bags, y = [rng.normal(size=(k, Q.FEATURES)) for k in (1, 3, 2)], np.array([1.0, 0.0, 1.0])
    sizes = np.array([len(b) for b in bags])
    at = np.r_[0, np.cumsum(sizes)[:-1]]
    f = net.forward(np.concatenate(bags), at, sizes)
    grads = net.gradients(f, at, sizes, f["y"] - y)

    def loss():
        return -sum(math.log(s if t else 1 - s) for t, s in zip(y, (by_hand(net, b) for b in bags)))
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for i in rng.choice(flat.size, min(4, flat.size), replace=False):
            kept = flat[i]
            flat[i] = kept + 1e-5
            up = loss()
            flat[i] = kept - 1e-5
            down = loss()
            flat[i] = kept
            assert abs((up - down) / 2e-5 - np.ravel(g)[i]) < 1e-6, name
