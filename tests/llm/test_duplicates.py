"""Near-duplicates, repeated strings and benchmark passages against brute force."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tunelake.llm import string_tiling as G
from tunelake.llm import suffix_dedup as S
from tunelake.llm import tensor_dedup as D
from tunelake.llm.components import components

from helpers import empty, odd_documents, text


def lower(t):
    return re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())


def brute_groups(rows, size, num=80, den=100):
    sets = []
    for _, t in rows:
        w = lower(t)
        k = min(size, len(w))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(s), least.get(find(i)), d == least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def test_near_duplicates(spark):
    docs, rows = odd_documents(spark, n=25)
    for size in (4, 5):
        got = [tuple(r) for r in D.near_duplicates(docs, size).collect()]
        assert sorted(got, key=repr) == sorted(brute_groups(rows, size), key=repr)
    assert D.near_duplicates(empty(spark)).count() == 0


def test_large_bucket_of_near_copies(spark):
    """Copies near one text, most of them not near each other, and a passage that all texts share."""
    rng = random.Random(4)
    base, passage = text(rng, 150).split(), text(rng, 60)
    rows = []
    for i in range(90):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 7)):
            w[k] = f"w{rng.randrange(10 ** 6)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, passage + " " + " ".join(f"v{rng.randrange(10 ** 6)}" for _ in range(90))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in D.near_duplicates(docs, 4).collect()]
    assert sorted(got) == sorted(brute_groups(rows, 4))


def test_batches_without_a_wanted_class(spark):
    """A task of which no row is shingled again gives no rows; sets of one size stay lists."""
    docs = spark.createDataFrame([(0, "a b c d e f"), (1, "b c d e f g"), *[(i, "a b c d e f") for i in range(2, 40)]],
                                 "doc_id long, text string").repartitionByRange(8, "doc_id")
    digests = {r.doc_id: r.digest for r in D.signatures(docs, 5).collect()}
    wanted = spark.createDataFrame([(7, 0, digests[0]), (8, 1, digests[1])], "cls long, doc_id long, digest binary")
    got = {r.cls: r["items"] for r in D._sets(docs, wanted, 5).collect()}
    shingles = D.Shingler(5)
    assert got == {7: shingles("a b c d e f").astype(np.int64).tolist(), 8: shingles("b c d e f g").astype(np.int64).tolist()}


def test_one_row_of_each_group(spark):
    docs, rows = odd_documents(spark, n=25)
    got = D.without_near_duplicates(docs).collect()
    want = {(d, t) for (d, t), (_, _, _, kept) in zip(rows, brute_groups(rows, 5)) if kept or d is None}
    # A null id never names a group: it stays unless its group has another member.
    assert {(r.doc_id, r.text) for r in got if r.doc_id is not None} == {w for w in want if w[0] is not None}
    assert got[0].asDict().keys() == set(docs.columns)


def test_components(spark):
    rng = random.Random(1)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [
        (rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(120)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    near = {}
    for a, b in pairs:
        if a is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)
    assert set(got) == set(near)


def brute_cut(rows, length):
    last = 1 << 63
    least = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - length + 1):
            w = raw[i:i + length]
            least[w] = min(least.get(w, last), last if d is None else d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if least[raw[i:i + length]] < (last if d is None else d):
                gone[i:i + length] = b"\1" * length
        out.append((d, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))),
                    bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def test_repeated_strings(spark, monkeypatch):
    docs, rows = odd_documents(spark, n=20)
    rng = random.Random(2)
    shared = "é" * 40 + text(rng, 12)
    extra = [(200 + i, text(rng, 5) + shared[rng.randrange(30):] + text(rng, 5)) for i in range(8)]
    rows = rows + extra
    docs = docs.select("doc_id", "text", "part").unionByName(
        spark.createDataFrame([(*r, 0) for r in extra], "doc_id long, text string, part int"))
    for length in (50, 30):
        cut = S.with_spans(docs, S.repeated_spans(docs, length))
        got = cut.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))), F.coalesce(F.aggregate(
            "spans", F.lit(0).cast("long"), lambda a, r: a + r["stop"] - r["start"]), F.lit(0)),
            F.coalesce(F.size("spans"), F.lit(0)), S.kept_bytes()).collect()
        assert sorted(((*r[:4], bytes(r[4])) for r in got), key=repr) == sorted(brute_cut(rows, length), key=repr)
    assert S.with_spans(empty(spark), S.repeated_spans(empty(spark))).count() == 0
    left = {r.doc_id: r.text for r in S.without_repeats(docs).collect()}
    assert "é" in left[200] and all(t is None or t.encode() for t in left.values() if t)


def test_interval_expansion():
    rng = random.Random(5)
    for _ in range(40):
        letters = rng.choice([b"ab", b"abcdefgh", b"a"])
        base = [bytes(rng.choice(letters) for _ in range(rng.randint(1, 60))) for _ in range(6)]
        texts = sorted({b"".join(rng.choice(base) for _ in range(rng.randint(1, 5))) for _ in range(12)})
        docs, length = np.array([rng.randrange(8) for _ in texts]), rng.choice([3, 7, 20])
        least = {}
        for x, d in zip(texts, docs):
            for i in range(len(x) - length + 1):
                least[x[i:i + length]] = min(least.get(x[i:i + length], 99), d)
        want = [least[x[i:i + length]] if i + length <= len(x) else S.LAST_ID for x in texts for i in range(len(x))]
        assert S.least_documents(texts, docs, length).tolist() == want


def brute_tiles(doc, item, size):
    """Longest unmarked common run first, by trying all places."""
    used_d, used_i, covered = set(), set(), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while (p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n]
                       and p + n not in used_d and q + n not in used_i):
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < size:
            return covered
        used_d.update(range(p, p + n))
        used_i.update(range(q, q + n))
        covered += n


def test_tiles_against_brute_force(spark):
    rng = random.Random(8)
    items = [(1, text(rng, 40)), (2, text(rng, 25)), (3, "only three words"), (4, None), (5, ""), (None, "a b"),
             (2, "zzz later copy of an id")]
    a, b = items[0][1].split(), items[1][1].split()
    rows = [(1, text(rng, 30) + " " + items[0][1] + " " + text(rng, 30)),
            (2, " ".join(a[20:] + ["mid"] + a[:20])),                       # two halves in another order
            (3, " ".join(b[:12])), (4, "now only three words here"), (5, None), (6, ""), (7, text(rng, 300)),
            (None, items[0][1].upper() + "!"), (1, text(rng, 20))]
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, coverage double")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n_items int")
    texts = {1: items[0][1], 2: min(items[1][1], items[6][1]), 3: items[2][1]}
    want = []
    for d, t in rows:
        best, n = (0.0, None), 0
        for i in sorted(texts):
            words = G.words_of(texts[i])
            got = brute_tiles(G.words_of(t), words, min(5, len(words)))
            n += got > 0
            if got / len(words) > best[0]:
                best = (got / len(words), i)
        want.append((d, best[1], n, best[0], best[0] >= 0.6, best[0] < 0.6))
    for limit in (10 ** 6, 0):
        got = [tuple(r) for r in G.tiling(docs, bench, broadcast_words=limit).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
        assert G.tiling(empty(spark), bench, broadcast_words=limit).count() == 0
        clean = G.tiling(docs, bench.limit(0), broadcast_words=limit)
        assert clean.where("kept").count() == len(rows)
    assert G.decontaminated(docs, bench).columns == docs.columns
