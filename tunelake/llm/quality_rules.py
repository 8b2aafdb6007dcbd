"""Quality rules: a threshold table compiled into one Spark projection.

Every rule is a row ``(name, metric, low, high)``; a text passes when each
metric lies in its closed range.  Metrics are ratios of counts that are all
native expressions (no user functions); the whole filter is one projection
over the scan, with no shuffle, so it scales with the number of splits.

Cases: a null or empty text has no words and fails; texts of any length are
read whole; repeated rows are judged one by one; an empty table gives an empty
table; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import WORD

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "on", "are", "with", "this",
    "der", "die", "das", "und", "ist", "den", "von", "zu", "ein", "nicht",
    "le", "la", "les", "de", "des", "du", "et", "une", "en", "que",
    "el", "los", "las", "y", "un", "por", "con", "del", "se", "es",
)


@dataclass(frozen=True)
class Threshold:
    name: str
    metric: str
    low: float | None = None
    high: float | None = None


# Production table.  `base` rows decide base_failed, the others the verdict.
BASE = (
    Threshold("few_words", "n_words", low=50),
    Threshold("repeated_windows", "repeat_ratio", high=0.5),
)
RULES = (
    Threshold("word_length", "mean_word_chars", low=2.0, high=14.0),
    Threshold("symbols", "symbol_ratio", high=0.1),
    Threshold("stop_words", "stop_ratio", low=0.01),
    Threshold("repeated_lines", "dup_line_ratio", high=0.3),
    Threshold("bullet_lines", "bullet_line_ratio", high=0.9),
    Threshold("cut_lines", "ellipsis_line_ratio", high=0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


# Up to so many repeated hashes of one text are looked up one by one.
FEW_REPEATS = 64


def _let(value: Column, body) -> Column:
    """``body(value)`` with value computed once: transform over one element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Number of word positions inside a 3-word window that occurs twice or more.

    Window hashes are sorted as plain longs; most texts have no equal pair and
    are done.  Otherwise the windows with a repeated hash are sorted by (hash,
    words) and compared with their neighbours, so equal hashes of different
    words don't count.  O(n log n) for one text, whatever its length.
    """
    def windows(w: Column, h: Column, keep) -> Column:
        return F.filter(
            F.transform(h, lambda v, i: F.struct(v.alias("h"), w[i].alias("a"), w[i + 1].alias("b"),
                                                 w[i + 2].alias("c"), i.alias("i"))), lambda x: keep(x["h"]))

    def same(x, y):
        return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

    def repeated(s: Column) -> Column:
        return F.transform(
            F.filter(s, lambda x, k: ((k > 0) & same(x, F.get(s, k - 1)))
                     | ((k < F.size(s) - 1) & same(x, F.get(s, k + 1)))), lambda x: x["i"])

    def count(at: Column) -> Column:
        return F.aggregate(
            F.sort_array(at),
            F.struct(F.lit(0).alias("total"), F.lit(0).alias("upto")),
            lambda acc, p: F.struct((acc["total"] + p + 3 - F.greatest(p, acc["upto"])).alias("total"),
                                    (p + 3).alias("upto")),
            lambda acc: acc["total"])

    def covered(w: Column, h: Column, twice: Column) -> Column:
        few = F.size(twice) <= FEW_REPEATS
        cand = windows(w, h, lambda v: ~few | F.array_contains(twice, v))
        return F.when(F.size(twice) == 0, F.lit(0)).otherwise(count(_let(F.sort_array(cand), repeated)))

    def hashed(w: Column) -> Column:
        h = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))
        return _let(h, lambda h: _let(
            _let(F.sort_array(h), lambda s: F.array_distinct(
                F.filter(s, lambda v, k: (k > 0) & (v == F.get(s, k - 1))))),
            lambda twice: covered(w, h, twice)))

    return F.when(F.size(words) >= 3, _let(words, hashed)).otherwise(F.lit(0)).cast("long")


def with_metrics(df: DataFrame, text: str = "text") -> DataFrame:
    """Add counts and ratios for ``text``; columns of the same names are replaced."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.array_remove(F.split(t, r"[\x20\x09-\x0D]+"), "")
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    df = df.withColumns({"_words": words, "_lines": lines, "_text": t})
    w, ln, t = F.col("_words"), F.col("_lines"), F.col("_text")
    n_lines = F.size(ln)

    def starts(x, *marks):
        return reduce(or_, [F.ltrim(x).startswith(m) for m in marks])

    def ends(x, *marks):
        return reduce(or_, [F.rtrim(x).endswith(m) for m in marks])

    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": F.when(t.rlike(r"[#*$%&|<>]"), F.length(t) - F.length(F.translate(t, "#*$%&|<>", "")))
        .otherwise(0).cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": _repeat_words(w),
        "n_stop_words": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        "n_bullet_lines": F.size(F.filter(ln, lambda x: starts(x, "- ", "* ", "• "))).cast("long"),
        "n_cut_lines": F.size(F.filter(ln, lambda x: ends(x, "...", "…"))).cast("long"),
        "n_lines": n_lines.cast("long"),
    }).drop("_words", "_lines", "_text")
    n = F.col("n_words")
    return df.withColumns({
        "mean_word_chars": _ratio(F.col("word_chars"), n),
        "symbol_ratio": _ratio(F.col("n_symbols"), n),
        "stop_ratio": _ratio(F.col("n_stop_words"), n),
        "repeat_ratio": _ratio(F.col("n_repeat_words"), n),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_ratio": _ratio(F.col("n_bullet_lines"), F.col("n_lines")),
        "ellipsis_line_ratio": _ratio(F.col("n_cut_lines"), F.col("n_lines")),
    })


def passes(rules) -> Column:
    """The table as one boolean expression."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (F.col(r.metric) >= F.lit(r.low))
        if r.high is not None:
            out = out & (F.col(r.metric) <= F.lit(r.high))
    return out


def quality_rules(docs: DataFrame, rules=RULES, base=BASE, text: str = "text") -> DataFrame:
    """``docs`` (doc_id, text) with counts, ratios, base_failed and kept."""
    df = with_metrics(docs.select("doc_id", F.col(text).alias("text")), "text")
    failed = ~passes(base)
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & passes(rules))
