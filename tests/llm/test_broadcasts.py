"""What is broadcast has a proven bound: the tables of hash slots alone, however small Spark takes a table for."""

import re

from tunelake.llm import components as K
from tunelake.llm import string_tiling as G
from tunelake.llm import suffix_dedup as S
from tunelake.llm import tensor_dedup as T

WORDS = [f"w{i}" for i in range(60)]


def documents(spark):
    rows = []
    for g in range(6):
        for k in range(5):  # near copies, one word apart, and a passage that two groups share
            words = [f"{w}g{g // 2 if i < 30 else g}" for i, w in enumerate(WORDS)]
            words[k + 40] = f"copy{k}"
            rows.append((g * 5 + k, " ".join(words)))
    return spark.createDataFrame([*rows, (None, "a b c d e f"), (100, None)], "doc_id long, text string")


def plans(monkeypatch, *modules):
    """The plans of all tables that ``modules`` write, as Spark makes them before it has seen any row."""
    seen = []

    def written(df, *args, scratch=K.scratch, **kw):
        seen.append(planned(df))
        return scratch(df, *args, **kw)
    for m in modules:
        monkeypatch.setattr(m, "scratch", written)
    return seen


def planned(df):
    return df._jdf.queryExecution().sparkPlan().toString()


def unbounded(plan):
    return re.findall(r"(?:BroadcastHashJoin|BroadcastNestedLoopJoin)(?! \[_slot#).*", plan)


def test_near_dedup_broadcasts_slots_alone(spark, monkeypatch):
    seen = plans(monkeypatch, T, K)
    out = T.without_near_duplicates(documents(spark))
    assert {r["doc_id"] for r in out.collect()} == {None, 0, 5, 10, 15, 20, 25, 100}
    found = [x for p in [*seen, planned(out)] for x in unbounded(p)]
    assert not found and sum("Join" in p for p in seen) > 5


def test_suffix_dedup_broadcasts_slots_alone(spark, monkeypatch):
    seen = plans(monkeypatch, S)
    out = S.without_repeats(documents(spark))
    assert out.count() == 32
    found = [x for p in [*seen, planned(out)] for x in unbounded(p)]
    assert not found and sum("Join" in p for p in seen) > 0


def test_large_benchmarks_are_not_broadcast(spark, monkeypatch):
    seen = plans(monkeypatch, G)
    items = spark.createDataFrame([(1, " ".join(f"{w}g0" for w in WORDS[:30])), (2, "not in any of them at all")],
                                  "item_id long, text string")
    out = G.tiling(documents(spark), items, broadcast_words=0)
    assert out.where("contaminated").count() == 10
    assert not [x for p in [*seen, planned(out)] for x in unbounded(p)]
