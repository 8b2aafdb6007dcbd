"""Null and repeated ids, rare terms and pairs: nothing of the input is left out."""

import random

import numpy as np
from pyspark.sql import functions as F

from tunelake.llm import string_tiling as G
from tunelake.llm import suffix_dedup as S
from tunelake.llm import tensor_dedup as D
from tunelake.llm import toxicity as T

from helpers import text
from test_duplicates import brute_cut, brute_groups


def test_tiling_of_all_texts_of_an_id(spark):
    """Test sets that are each numbered from 0, and items without an id."""
    rng = random.Random(11)
    passages = [text(rng, 30) for _ in range(6)]
    bench = spark.createDataFrame(
        [(0, passages[0]), (0, passages[1]), (1, passages[2]), (1, passages[3]), (1, passages[3]), (None, passages[4]),
         (None, passages[5]), (None, passages[2])], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"{text(rng, 9)} {p} {text(rng, 9)}") for i, p in enumerate(passages)]
                                 + [(6, passages[4] + " " + passages[1])], "doc_id long, text string")
    for limit in (10 ** 6, 0):
        got = {r.doc_id: r for r in G.tiling(docs, bench, broadcast_words=limit).collect()}
        assert all(r.coverage == 1.0 and r.contaminated and not r.kept for r in got.values())
        assert [got[i].item_id for i in range(7)] == [0, 0, 1, 1, None, None, 0]
        assert got[2].n_items >= 2 and got[6].n_items >= 2
    assert G.decontaminated(docs, bench).count() == 0


def test_repeats_of_null_and_repeated_ids(spark):
    """Two texts of no id and two of one id share a passage with a smaller document, all in one group."""
    rng = random.Random(12)
    shared = text(rng, 20)
    rows = [(1, text(rng, 20) + shared + text(rng, 20))]
    for d in (None, None, 7, 7):
        rows.append((d, text(rng, rng.randint(5, 60)) + shared + text(rng, rng.randint(5, 60))))
    rows.append((7, rows[-1][1]))
    other = text(rng, 20)  # of the smallest id of its group: its texts lose nothing here
    rows += [(d, text(rng, rng.randint(5, 30)) + other) for d in (3, 3, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    cut = S.with_spans(docs, S.repeated_spans(docs))
    got = [(r.doc_id, bytes(r.left)) for r in cut.select("doc_id", S.kept_bytes().alias("left")).collect()]
    assert sorted(got, key=repr) == sorted(((r[0], r[4]) for r in brute_cut(rows, S.LENGTH)), key=repr)


def test_one_row_of_groups_with_null_and_repeated_ids(spark):
    rng = random.Random(13)
    t = [text(rng, 60) for _ in range(8)]

    def near(i):
        return t[i] + " " + text(rng, 1)
    rows = [(1, t[0]), (None, t[0]), (None, near(0)), (None, None), (None, ""),     # null ids beside a number
            (None, t[1]), (None, t[1]), (None, near(1)),                            # null ids alone
            (5, t[2]), (5, near(2)), (5, t[3]), (6, near(3)),                       # two texts of one id
            (4, t[4]), (5, near(4)), (9, t[5]), (9, t[5].upper()), (9, t[6]), (8, None), (8, " ")]
    groups = {}
    for (d, x), (_, n, least, _) in zip(rows, brute_groups(rows, 5)):
        if n:
            i = next(i for i in range(8) if x.lower().startswith(t[i]))
            groups.setdefault(i, []).append((d, x))
    docs = spark.createDataFrame([(d, x, i) for i, (d, x) in enumerate(rows)], "doc_id int, text string, part int")
    got = [(r.doc_id, r.text) for r in D.without_near_duplicates(docs.repartition(3)).collect()]
    for members in groups.values():
        left = [g for g in got if g in members]
        ids = [d for d, _ in members if d is not None]
        assert len(left) == 1 and left[0][0] == (min(ids) if ids else None)
    assert sorted((g for g in got if not (g[1] or "").strip()), key=repr) == sorted(
        [(None, None), (None, ""), (8, None), (8, " ")], key=repr)
    assert len(got) == len(groups) + 4


def fitted(rows):
    m = T.fit_machine([T.term_buckets(t, {}) for t, _ in rows], np.array([y for _, y in rows]))
    return lambda texts: m.margins([m.position(T.term_buckets(t, {})) for t in texts])


def test_exclusive_or_among_noise_words():
    """Either word alone is toxic, both together are not: a single word tells nothing."""
    rng = random.Random(14)
    rows = []
    for _ in range(4500):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = [f"n{rng.randrange(4000)}" for _ in range(30)] + ["vermin"] * a + ["martians"] * b
        rows.append((" ".join(words), int(a != b)))
    margins = fitted(rows[:3500])([t for t, _ in rows[3500:]])
    assert np.mean((margins >= 0) == [y for _, y in rows[3500:]]) > 0.97


def test_insult_seen_once_or_twice():
    rng = random.Random(15)

    def noise():
        return " ".join(f"n{rng.randrange(300)}" for _ in range(12))
    rows = [(noise() + " " + rng.choice(["vermin", "cretin", "numbskull"]) * y, y) for y in (0, 1) for _ in range(300)]
    rows += [(noise() + " blockhead", 1), (noise() + " blockhead", 1), (noise() + " dunderpate", 1)]
    judge, plain = fitted(rows), [noise() for _ in range(50)]
    for word in ("blockhead", "dunderpate"):
        assert min(judge([f"{t} {word}" for t in plain]) - judge(plain)) > 0.5
