"""Quality rules, the SQL of the queries, and the pipeline against brute force."""

import collections
import re

import duckdb
import public_tokenizers
import sentencepiece

import corpus_pipeline
from tunelake.llm import passage_quality as Q
from tunelake.llm.oracle import SQL
from tunelake.llm.quality_rules import quality_rules
from tunelake.llm.queries import QUERIES

from helpers import empty, odd_documents
from test_duplicates import brute_cut, brute_groups

SF = "/root/testdata/sf0.01"


def brute_counts(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    windows = collections.Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)),
            len(inside))


def test_rule_counts(spark):
    docs, rows = odd_documents(spark)
    more = [(500, "a b c\n" * 70), (501, "one two three four " * 40), (502, "x\n\nx\n \nx| #"), (503, "..." * 9),
            (504, " ".join(f"w{i % 97}" for i in range(400)))]
    docs = docs.select("doc_id", "text", "score").unionByName(
        spark.createDataFrame([(*r, 1) for r in more], "doc_id long, text string, score int"))
    got = [tuple(r) for r in quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()]
    want = []
    for d, t in rows + more:
        c = brute_counts(t)
        want.append((d, *c, c[0] < 50 or 100 * c[4] > 50 * c[0]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert quality_rules(empty(spark)).count() == 0
    assert "Python" not in quality_rules(docs)._jdf.queryExecution().toString()


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, SF)
        result = con.execute(sql)
        names = [d[0] for d in result.description]
        assert sorted(names) == sorted(got.columns)
        assert sorted(map(tuple, got.select(*names).collect())) == sorted(result.fetchall())


def test_pipeline(spark):
    """Each stage on the rows of the stage before."""
    base = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{base}/documents.parquet")
    bench = [G for G in (re.findall(r"\w+", (r.text or "").lower()) for r in spark.read.parquet(
        f"{base}/benchmark.parquet").collect()) if G]
    columns, frames = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, base)
        after = out.collect()
        rows = [(r.doc_id, r.text) for r in before]
        if name == "quality":
            assert {r.doc_id for r in after} <= {d for d, _ in rows} and len(after) > 0.7 * len(rows)
        elif name == "near_dedup":
            assert sorted((r.doc_id, r.text) for r in after) == sorted(
                r for r, g in zip(rows, brute_groups(rows, 5)) if g[3])
        elif name == "suffix_dedup":
            want = {d: (n, raw) for d, _, n, _, raw in brute_cut(rows, 50)}
            for r in after:
                # Parts of a character at the ends of a span stay.
                assert 0 <= len(r.text.encode()) - len(want[r.doc_id][1]) <= 6 * (want[r.doc_id][0] > 0)
                assert r.n_chars == len(r.text) or not want[r.doc_id][0]
        elif name == "decontaminate":
            def met(t):
                w = " ".join(re.findall(r"\w+", t.lower()))
                return any(" ".join(b) in w for b in bench)
            gone = {d for d, _ in rows} - {r.doc_id for r in after}
            assert gone == {d for d, t in rows if met(t)}
        else:
            library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
            texts = dict(rows)
            for r in after:
                assert list(r.ids) == library.encode(texts[r.doc_id]) + [2] and r.text == texts[r.doc_id]
        if name != "tokens":
            assert out.columns == columns
        frames[name] = out
        docs = out
    assert len(after) == len(before)


def test_passages_cover_whole_texts():
    t = " ".join(["word"] * 1000)
    assert len(Q.passage_features(t)) == -(-1000 // Q.PASSAGE) and len(Q.passage_features("")) == 1
