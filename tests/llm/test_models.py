"""Language model, classifiers and URL trees."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tunelake.llm import katz as K
from tunelake.llm import passage_quality as Q
from tunelake.llm import toxicity as T
from tunelake.llm import url_filter as U
from tunelake.llm.common import held_out

from helpers import empty, odd_documents, text


def brute_katz(rows, modulus=7, remainder=2):
    seqs = [[None, *re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b""] for _, t in rows]
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % modulus == remainder for d, _ in rows]
    uni, bi = collections.Counter(), collections.defaultdict(collections.Counter)
    for s, h in zip(seqs, held):
        if not h:
            for a, b in zip(s, s[1:]):
                uni[b] += 1
                bi[a][b] += 1
    total, kinds = sum(uni.values()), len(uni)
    du = K.discounts(collections.Counter(uni.values()))
    db = K.discounts(collections.Counter(c for x in bi.values() for c in x.values()))

    def cut(c, d):
        return c * (d[c] if c < len(d) else 1.0)
    mass = sum(cut(c, du) for c in uni.values())
    scale = 1.0 if mass < total else total / (total + 1)
    rest = 1 - mass / total * scale

    def p1(w):
        return cut(uni[w], du) * scale / total if uni[w] else rest

    def p(a, b):
        seen = bi.get(a)
        if not seen:
            return p1(b)
        c = sum(seen.values())
        lost = c - sum(cut(x, db) for x in seen.values())
        if b in seen:
            return cut(seen[b], db) / c if lost > 1e-12 else seen[b] / (c + 1)
        return (lost / c if lost > 1e-12 else 1 / (c + 1)) / (1 - sum(p1(w) for w in seen)) * p1(b)
    for a in list(bi)[:20]:
        assert abs(sum(p(a, w) for w in uni) + p(a, b"\0new") - 1) < 1e-9
    out = []
    for (d, _), s, h in zip(rows, seqs, held):
        out.append((d, h, len(s) - 1, sum(uni[w] > 0 for w in s[1:]), total,
                    sum(math.log10((uni[w] + 1) / (total + kinds + 1)) for w in s[1:]),
                    sum(math.log10(p(a, b)) for a, b in zip(s, s[1:]))))
    return out


@pytest.mark.parametrize("hot", [1, 1000])
def test_katz(spark, monkeypatch, hot):
    """hot = 1: no word is spread; hot = 1000: in so small a corpus nearly all are."""
    monkeypatch.setattr(K, "HOT", hot)
    monkeypatch.setattr(K, "GROUP_BYTES", 4000)
    docs, rows = odd_documents(spark)
    got = K.katz_scores(docs, held_out(F.col("doc_id"), 7, 2)).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()
    want = brute_katz(rows)

    def key(r):
        return (r[0] is None, r[0] or 0, r[2], round(r[6], 3))
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:5] == w[:5]
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    assert K.katz_scores(empty(spark), F.lit(False)).count() == 0


def test_discounts():
    assert (K.discounts({}) == 1).all()
    d = K.discounts({1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 50})
    assert (d[1:] > 0).all() and (d[1:] <= 1).all()
    # Katz's condition: what the discounts take is the mass of the pairs seen once.
    n = {1: 1000, 2: 400, 3: 200, 4: 120, 5: 80, 6: 50}
    assert sum(r * n[r] * (1 - d[r]) for r in range(1, 6)) == pytest.approx(n[1])


def toxic_rows(n, seed):
    """Label 1 only where an insult meets a group: neither word says it alone."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words = text(rng, 30).split() + ["vermin"] * insult + ["martians"] * group
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(insult and group)))
    return rows


def test_pairs_of_words(spark):
    rows = toxic_rows(1500, 3)
    docs = spark.createDataFrame([(d, t) for d, t, _ in rows], "doc_id long, text string").repartition(2)
    labels = spark.createDataFrame([(d, y) for d, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in T.toxicity(docs, labels).collect()}
    held = [(got[d], y) for d, _, y in rows if got[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in got.items())
    assert np.mean([(r.score >= 0.5) == (y == 1) for r, y in held]) > 0.97


@pytest.mark.parametrize("operator,label", [(T.toxicity, "toxic"), (Q.quality, "quality")])
def test_classifier_cases(spark, operator, label):
    docs, rows = odd_documents(spark)
    for given in ([], [(1, 1), (2, 1), (4, 1)], [(i, i % 2) for i in range(30)]):
        labels = spark.createDataFrame(given, f"doc_id long, {label} int")
        got = operator(docs, labels).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert operator(empty(spark), spark.createDataFrame([], f"doc_id long, {label} int")).count() == 0


@pytest.mark.parametrize("operator,label,limit", [(T.toxicity, "toxic", 0.85), (Q.quality, "quality", 0.97)])
def test_held_out_accuracy(spark, operator, label, limit):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    got = operator(docs, labels).where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    right = {v: np.mean([p == v for p, y in got if y == v]) for v in (0, 1)}
    assert min(right.values()) >= limit - 0.05 and np.mean([p == y for p, y in got]) >= 0.97


def test_gradients():
    """Of the attention network, against differences."""
    rng = np.random.default_rng(0)
    bags, y = [rng.normal(size=(n, Q.FEATURES)) for n in (1, 3, 5)], np.array([0, 1, 1])
    p = {k: rng.normal(0, 0.5, s) for k, s in Q.SHAPES.items()}
    net = Q.Network(np.zeros(Q.FEATURES), np.ones(Q.FEATURES), p)
    x, sizes = np.concatenate(bags), np.array([1, 3, 5])
    at = np.array([0, 1, 4])

    def loss():
        z = net.forward(x, at, sizes)["y"]
        return -(y * np.log(z) + (1 - y) * np.log(1 - z)).sum()
    f = net.forward(x, at, sizes)
    grads = net.gradients(f, at, sizes, f["y"] - y)
    for name, g in grads.items():
        flat = net.p[name].reshape(-1)
        for k in range(0, flat.size, max(1, flat.size // 5)):
            was = flat[k]
            flat[k] = was + 1e-5
            up = loss()
            flat[k] = was - 1e-5
            down = loss()
            flat[k] = was
            assert g.reshape(-1)[k] == pytest.approx((up - down) / 2e-5, abs=1e-5)


URLS = ["http://a.net/x", "https://WWW.Example.NET/en/1?q=1", "http://example.net/en", "ftp://example.com/de/2#x",
        "http://notexample.com/de/", "http://x.org/fr/3", "http://org/fr/", "http://x.org", "x.org/fr/", None, "",
        "://", "http://", "http://net", "http://net/", "a://b://c.net/", "http://u@h.net:80/p?x://y"]


def brute_url(u):
    if u is None or "://" not in u:
        return "", "", None
    rest = u.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for r in U.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name)) if fits else None


def test_url_rules(spark):
    urls = URLS + [f"https://h{i}.example.{t}/{p}/{i}" for i in range(40) for t, p in (
        ("net", "en"), ("net", "de"), ("com", "de"), ("org", "fr"), ("com", "en"))]
    pages = spark.createDataFrame([(i, u, 1.0) for i, u in enumerate(urls)] + [(None, urls[0], None)],
                                  "page_id long, url string, score double")
    for r in U.url_filter(pages, trees=3).collect():
        host, path, rule = brute_url(urls[r.page_id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict in ("allow", "block") and (rule is None or r.verdict == rule.verdict)
    plan = U.url_filter(pages, trees=1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    none = spark.createDataFrame([], "page_id long, url string")
    assert U.url_filter(none).count() == 0


def test_trees_against_brute_force(spark):
    """One tree of depth one on a known split, and learning beyond one feature."""
    rng = random.Random(6)
    urls = []
    for i in range(300):
        bad = rng.random() < 0.5
        urls.append((i, f"http://h{rng.randrange(9)}.x/" + ("a/" * rng.randint(5, 8) if bad else "b/" * rng.randint(1, 3)),
                     int(bad)))
    df = spark.createDataFrame(urls, "page_id long, url string, label int")
    f = U.with_features(U.with_host_path(df)).withColumn("suffix_rate", F.lit(0.5))
    model = U.fit(f, trees=1, depth=1, rate=1.0)
    (feature, cut), = model.trees[0].splits.values()
    n1 = sum(u[2] for u in urls)
    p = n1 / len(urls)
    by = collections.defaultdict(list)
    rows = f.select("label", *U.FEATURES).collect()
    for r in rows:
        by[sum(r[feature] > c for c in model.cuts[feature]) > cut].append(r["label"])
    for side, labels in by.items():
        want = sum(y - p for y in labels) / (len(labels) * p * (1 - p) + U.RIDGE)
        assert model.trees[0].leaves[(1, int(side))] == pytest.approx(want)
    assert np.mean([len(set(v)) == 1 for v in by.values()]) == 1


def test_url_features_by_hand(spark):
    """Every feature from its definition."""
    import math
    urls = ["http://A.b.example.com/x/y/12?p=1&q&&r=2#f?z=1", "https://h.org", "", None, "no scheme?a=b", "http://e.net/#x?y=1",
            "http://ü.example/ß?" + "&".join(f"k{i}" for i in range(50))]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in U.with_features(U.with_host_path(df)).collect():
        u = urls[r.page_id] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group(0)
        path = re.match(r"[^?#]*", rest[len(host):]).group(0)
        host = "".join(c.lower() if c.isascii() else c for c in host)
        query = u.split("#")[0].split("?", 1)[1] if "?" in u.split("#")[0] else ""
        shape = host + path
        share = [shape.count(c) / len(shape) for c in set(shape)]
        want = (len(u), len(host), path.count("/"), sum(c in "0123456789" for c in u) / len(u) if u else 0.0,
                -sum(p * math.log2(p) for p in share), sum(bool(p) for p in query.split("&")), host.count("."))
        got = (r.length, r.host_length, r.depth, r.digit_ratio, r.entropy, r.n_params, r.labels)
        assert all(abs(a - b) < 1e-9 for a, b in zip(got, want)), (u, got, want)
        assert r.suffix == host.rsplit(".", 1)[-1]


def test_bins_by_hand(spark):
    import bisect
    cuts, values = [-1.0, 0.0, 0.5, 2.0], [-5.0, -1.0, -0.5, 0.0, 0.1, 0.5, 1.9, 2.0, 3.0]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    assert [r.b for r in df.select(U._bin(F.col("v"), cuts).alias("b")).collect()] == [bisect.bisect_left(cuts, v) for v in values]
