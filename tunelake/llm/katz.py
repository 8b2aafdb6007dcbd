"""Katz backoff language model over words, with Good-Turing discounts.

    P(w | h) = d(c) * c(h w) / c(h)                     if h w was seen c times in training
             = a(h) * P(w)                              otherwise
    P(w)     = d(c) * c(w) / N, and the rest of the mass for a word never seen
    a(h)     = (1 - sum of the first kind) / (1 - sum of P over the words seen after h)

so that every context sums to one exactly.  d is Katz's discount for counts up
to ``CUTOFF`` from the counts of counts; larger counts keep their share.

Training and scoring work on groups of documents, each packed with its own
list of words.  Counts travel by word or by pair in packed blobs:

1. groups:    documents -> (words, word numbers), written once;
2. unigrams:  the words of a group go to the part of each word, which adds up
              the training counts and answers with number and count;
3. bigrams:   the distinct pairs of a group go to the part of their first word,
              which adds them up, keeps the table and answers with the pair
              counts and the sums that a(h) is made of;
4. scores:    with these answers a group scores its documents by itself.

A word or pair is one row for each group that has it, however often it
occurs.  A frequent first word (one of at most ``HOT``) is spread over all
parts by pair, and its sums are added up afterwards.  Tables are kept in
Parquet, partitioned by kind.  Nothing but counts of counts and the sums of
hot words (at most HOT rows) comes to the driver.

Cases: null and empty texts are the end token alone; without training rows
every word is unknown and has the whole mass; a context whose words all exceed
the cutoff gives up 1 / (c + 1); a null id counts as the empty text in the
split; repeated rows are scored one by one and count each; long texts are read
whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import deltas, pack, partitions, release_part, scratch, tidy, undeltas, unpack

CUTOFF = 5
HOT = 1000
GROUP_BYTES = 8 << 20
# Not words: words hold no white space and have a letter at least.
START, END = b" ", b""


def discounts(n_r: dict[int, int], cutoff: int = CUTOFF) -> np.ndarray:
    """Katz's d[0..cutoff]; d[0] is unused.

    The largest usable cutoff is taken: counts of counts must not be zero and
    every discount must lie in (0, 1].  Without any, nothing is discounted.
    """
    for k in range(cutoff, 0, -1):
        n = [n_r.get(r, 0) for r in range(k + 2)]
        if min(n[1:]) <= 0:
            continue
        top = (k + 1) * n[k + 1] / n[1]
        if top >= 1:
            continue
        d = [((r + 1) * n[r + 1] / (r * n[r]) - top) / (1 - top) for r in range(1, k + 1)]
        if all(0 < x <= 1 for x in d):
            return np.asarray([1.0, *d, *[1.0] * (cutoff - k)])
    return np.ones(cutoff + 1)


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return c * np.where(c < len(d), d[np.minimum(c, len(d) - 1)], 1.0)


@dataclass
class Unigrams:
    total: int
    kinds: int
    d: np.ndarray
    mass: float   # of all seen words before ``scale``
    scale: float

    @classmethod
    def of(cls, total: int, kinds: int, n_r: dict[int, int]) -> Unigrams:
        d = discounts(n_r)
        lost = sum(r * n_r.get(r, 0) * (1 - d[r]) for r in range(1, CUTOFF + 1))
        # Without a discount the unknown words would have no mass.
        scale = 1.0 if lost > 0 else total / (total + 1.0)
        return cls(total, kinds, d, (total - lost) / total if total else 0.0, scale)

    def p(self, c: np.ndarray) -> np.ndarray:
        """Probability of words of these counts; 0 stands for the unknown words."""
        unknown = 1.0 - self.mass * self.scale
        return np.where(c > 0, discounted(c, self.d) * self.scale / max(1, self.total), unknown)


def alpha(sums: np.ndarray, seen: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weights and factors of seen counts.  sums[:, r - 1]: occurrences of pairs seen r
    times (last column: more than CUTOFF); seen: unigram mass of the words seen."""
    total = sums.sum(1)
    lost = sums[:, :CUTOFF] @ (1 - d[1:CUTOFF + 1])
    with np.errstate(divide="ignore", invalid="ignore"):
        scale = np.where(lost > 0, 1.0, total / (total + 1.0))
        left = np.where(lost > 0, lost / total, 1 / (total + 1.0))
        a = np.where(total > 0, left / np.maximum(1.0 - seen, 1e-300), 1.0)
    return a, scale


# --- 1. groups ----------------------------------------------------------------------

def _group(grp: int, rows: list) -> pd.DataFrame:
    """rows: (doc_id, known, held, words) -> packed documents (kind 0) and words with their training
    counts (kind 1).  Word 0 is START, word 1 END."""
    number: dict[bytes, int] = {START: 0, END: 1}
    out = []
    for *_, words in rows:
        for w in set(words).difference(number):
            number[w] = len(number)
        out.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
    tokens = np.concatenate(out)
    sizes = np.asarray([len(x) for x in out], np.uint32)
    ids, known, held = (np.asarray([r[k] for r in rows], t) for k, t in enumerate((np.int64, bool, bool)))
    n = np.bincount(tokens, np.repeat(~held, sizes), len(number)).astype(np.int64)
    n[1] = (~held).sum()
    words = pack(np.frombuffer(b"\n".join(number), np.uint8))
    return pd.DataFrame({"kind": [0, 1], "grp": grp, "first": [pack(deltas(ids), known, held, sizes), words],
                         "second": [pack(tokens), pack(n)]})


def _groups(batches):
    part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0
    for b in batches:
        for d, k, h, t in zip(b["doc_id"], b["known"], b["held"], b["text"]):
            raw = t.encode().lower()
            rows.append((d, k, h, raw.split()))
            size += len(raw) + 64
            if size >= GROUP_BYTES:
                yield _group(part << 32 | seq, rows)
                rows, size, seq = [], 0, seq + 1
    if rows:
        yield _group(part << 32 | seq, rows)


class Group:
    """A group as arrays: sequences of START, words, END of all documents one after another."""

    def __init__(self, docs: bytes, tokens: bytes):
        ids, self.known, self.held, sizes = unpack(docs)
        self.ids = undeltas(ids)
        self.sizes = sizes.astype(np.int64) + 1  # with END
        tokens = unpack(tokens)[0].astype(np.int64)
        ends = np.cumsum(self.sizes + 1)
        self.sequence = np.empty(ends[-1], np.int64)
        inner = np.ones(ends[-1], bool)
        inner[ends - 1] = False
        inner[np.r_[0, ends[:-1]]] = False
        self.sequence[inner] = tokens
        self.sequence[ends - 1] = 1
        self.sequence[np.r_[0, ends[:-1]]] = 0
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        follows = np.ones(ends[-1], bool)
        follows[np.r_[0, ends[:-1]]] = False
        at = np.flatnonzero(follows)
        self.word, self.before = self.sequence[at], self.sequence[at - 1]
        self.train = ~self.held[self.doc]

    def renumber(self, number: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Put the words in the order of their corpus numbers: (numbers, counts, place of START).

        Frequent words have small numbers, so lists of neighbours pack well.
        """
        by = np.argsort(number)
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.word, self.before = place[self.word], place[self.before]
        return number[by], count[by], int(place[0])

    def pairs(self, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (first, second) in order, training count, and the pair of each token."""
        code, which = np.unique(self.before * kinds + self.word, return_inverse=True)
        n = np.bincount(which, self.train, len(code)).astype(np.int64)
        return code // kinds, code % kinds, n, which


# --- 2. unigrams ---------------------------------------------------------------------

OUT = "kind int, part int, grp long, r long, n long, blob binary"


def _row(kind, part=0, grp=0, r=0, n=0, blob=None):
    return {"kind": kind, "part": part, "grp": grp, "r": r, "n": n, "blob": blob}


def _send_words(parts: int):
    def run(batches):
        for b in batches:
            for grp, words, n in zip(b["grp"], b["first"], b["second"]):
                words, n = unpack(words)[0].tobytes().split(b"\n"), unpack(n)[0]
                part = np.fromiter((zlib.crc32(w) for w in words), np.int64, len(words)) % parts
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                out = []
                for p in range(parts):
                    at = order[cut[p]:cut[p + 1]]
                    if len(at):
                        joined = b"\n".join([words[k] for k in at.tolist()])
                        out.append((p, grp, pack(at.astype(np.uint32), n[at], np.frombuffer(joined, np.uint8))))
                yield pd.DataFrame(out, columns=["part", "grp", "blob"])
    return run


def _add_words(parts: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part, sent, words = int(rows["part"].iloc[0]), [], []
        for grp, blob in zip(rows["grp"], rows["blob"]):
            at, n, raw = unpack(blob)
            some = raw.tobytes().split(b"\n")
            sent.append((grp, at, n))
            words += some
        which, kinds = pd.factorize(np.asarray(words, object))
        c = np.bincount(which, np.concatenate([s[2] for s in sent])).astype(np.int64)
        by = np.argsort(-c, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        which, c, kinds = rank[which], c[by], kinds[by]
        out, k = [], 0
        for grp, at, _ in sent:
            mine = which[k:k + len(at)]
            out.append(_row(0, part, grp, blob=pack(at, mine.astype(np.uint32), c[mine])))
            k += len(at)
        out.append(_row(1, part, r=0, n=int(c.sum())))
        out.append(_row(1, part, r=-1, n=int((c > 0).sum())))
        out += [_row(1, part, r=r, n=int((c == r).sum())) for r in range(1, CUTOFF + 2)]
        seen = np.flatnonzero(c)
        out.append(_row(2, part, blob=pack(c[seen], np.frombuffer(b"\n".join([kinds[i] for i in seen]), np.uint8))))
        return pd.DataFrame(out)
    return run


def _numbers(replies, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Corpus number and count of each word of a group."""
    got = [(r["part"], *unpack(r["blob"])) for r in replies]
    number, count = np.empty(sum(len(g[1]) for g in got), np.int64), np.empty(sum(len(g[1]) for g in got), np.int64)
    for part, at, mine, c in got:
        number[at] = mine.astype(np.int64) * parts + part
        count[at] = c
    return number, count


# --- 3. bigrams -----------------------------------------------------------------------

def _scatter(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _part_of(first, second, hot, parts: int) -> np.ndarray:
    return ((_scatter(first) + np.where(hot, _scatter(second + 1), np.uint64(0))) >> np.uint64(24)).astype(
        np.int64) % parts


def _split_pairs(g: Group, number, count, start: int, hot_from: float, parts: int):
    """Pairs of a renumbered group by part: (part, places in the pair list), always in the same order."""
    first, second, n, which = g.pairs(len(number))
    hot = (count >= hot_from) | (np.arange(len(number)) == start)
    part = _part_of(number[first], number[second], hot[first], parts)
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    return first, second, n, which, hot, [(p, order[cut[p]:cut[p + 1]]) for p in range(parts) if cut[p] < cut[p + 1]]


def _send_pairs(parts: int, hot_from: float):
    def run(batches):
        for b in batches:
            for grp, docs, tokens, replies in zip(b["grp"], b["first"], b["second"], b["words_in"]):
                g = Group(docs, tokens)
                number, count, start = g.renumber(*_numbers(replies, parts))
                first, second, n, _, hot, split = _split_pairs(g, number, count, start, hot_from, parts)
                out = []
                for p, at in split:
                    heads, run_length = np.unique(first[at], return_counts=True)
                    tails, tail = np.unique(second[at], return_inverse=True)
                    out.append((p, grp, pack(
                        deltas(number[heads]), hot[heads], run_length.astype(np.uint32), deltas(number[tails]), count[tails],
                        tail.astype(np.uint32), n[at].astype(np.uint32))))
                yield pd.DataFrame(out, columns=["part", "grp", "blob"])
    return run


def _columns(sums: np.ndarray) -> np.ndarray:
    """Bit r - 1: some word was seen r times after this one."""
    return ((sums > 0) << np.arange(CUTOFF + 1)).sum(1).astype(np.uint8)


def _add_pairs(uni: Unigrams):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        sent = [(grp, *unpack(blob)) for grp, blob in zip(rows["grp"], rows["blob"])]
        sent = [(s[0], undeltas(s[1]), s[2], s[3], undeltas(s[4]), *s[5:]) for s in sent]
        first = np.concatenate([np.repeat(s[1], s[3]) for s in sent])
        second = np.concatenate([s[4][s[6]] for s in sent])
        times = np.concatenate([s[5][s[6]] for s in sent])
        n = np.concatenate([s[7] for s in sent]).astype(np.int64)
        order = np.lexsort((second, first))
        f, s = first[order], second[order]
        start = np.flatnonzero(np.r_[True, (f[1:] != f[:-1]) | (s[1:] != s[:-1])])
        c = np.add.reduceat(n[order], start)
        pair = np.empty(len(order), np.int64)
        pair[order] = np.repeat(np.arange(len(start)), np.diff(np.r_[start, len(order)]))
        # Sums by first word over the pairs seen in training.
        f, s, p2 = f[start], s[start], uni.p(times[order][start]) * (c > 0)
        heads, head = np.unique(f, return_inverse=True)
        column = np.minimum(c, CUTOFF + 1) - 1
        sums = np.zeros((len(heads), CUTOFF + 1), np.int64)
        seen = c > 0
        np.add.at(sums, (head[seen], column[seen]), c[seen])
        mass = np.bincount(head, p2, len(heads))
        total, which = sums.sum(1), _columns(sums)
        out, k, is_hot = [], 0, np.zeros(len(heads), bool)
        for grp, mine, hot, length, _, _, tail, _ in sent:
            at = np.searchsorted(heads, mine)
            is_hot[at[hot]] = True
            answer = c[pair[k:k + len(tail)]]
            # Backoff weights are needed only for first words with a pair that training lacks.
            need = at[np.unique(np.repeat(np.arange(len(mine)), length)[answer == 0])]
            out.append(_row(0, part, grp, blob=pack(answer, total[at], which[at], sums[need].T.ravel(), mass[need])))
            k += len(tail)
        out += [_row(1, part, r=r, n=int((c == r).sum())) for r in range(1, CUTOFF + 2)]
        out.append(_row(2, part, blob=pack(deltas(f[seen]), s[seen], c[seen])))
        if is_hot.any():
            out.append(_row(3, part, blob=pack(heads[is_hot], sums[is_hot].ravel(), mass[is_hot])))
        return pd.DataFrame(out)
    return run


def _hot_sums(bigrams: DataFrame) -> dict:
    """Sums of the hot first words over all parts: at most HOT + 1 of them."""
    def read(batches):
        for b in batches:
            for blob in b["blob"]:
                head, sums, mass = unpack(blob)
                f = pd.DataFrame(sums.reshape(-1, CUTOFF + 1), columns=[f"s{k}" for k in range(CUTOFF + 1)])
                yield f.assign(head=head, mass=mass)

    names = [f"s{k}" for k in range(CUTOFF + 1)]
    rows = (bigrams.where("kind = 3").select("blob")
            .mapInPandas(read, ", ".join(f"{n} long" for n in names) + ", head long, mass double")
            .groupBy("head").agg(*[F.sum(n).alias(n) for n in names], F.sum("mass").alias("mass")).collect())
    return {r["head"]: ([r[n] for n in names], r["mass"]) for r in rows}


# --- 4. scores --------------------------------------------------------------------------

SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _score(parts: int, hot_from: float, uni: Unigrams, d: np.ndarray, hot_sums: dict):
    def run(batches):
        for b in batches:
            for docs, tokens, words_in, pairs_in in zip(b["first"], b["second"], b["words_in"], b["pairs_in"]):
                g = Group(docs, tokens)
                number, count, start = g.renumber(*_numbers(words_in, parts))
                first, second, _, which, hot, split = _split_pairs(g, number, count, start, hot_from, parts)
                answers = {r["part"]: r["blob"] for r in pairs_in}
                c = np.empty(len(first), np.int64)
                sums, mass = np.zeros((len(number), CUTOFF + 1), np.int64), np.zeros(len(number))
                total, seen_as = np.zeros(len(number), np.int64), np.zeros(len(number), np.uint8)
                for p, at in split:
                    mine, n, columns, s, m = unpack(answers[p])
                    c[at] = mine
                    heads, need = np.unique(first[at]), np.unique(first[at][mine == 0])
                    total[heads], seen_as[heads] = n, columns
                    sums[need], mass[need] = s.reshape(CUTOFF + 1, -1).T, m
                for k in np.flatnonzero(hot):
                    sums[k], mass[k] = hot_sums.get(int(number[k]), (0, 0.0))
                    total[k], seen_as[k] = sums[k].sum(), _columns(sums[k:k + 1])[0]
                back, _ = alpha(sums, mass, d)
                # As in alpha(): a context that gives up nothing by its discounts is scaled.
                gives = seen_as & sum(1 << r for r in range(CUTOFF) if d[r + 1] < 1) > 0
                scale = np.where(gives, 1.0, total / (total + 1.0))
                p1 = uni.p(count)
                with np.errstate(divide="ignore", invalid="ignore"):
                    seen = discounted(c, d) * scale[first] / total[first]
                pair = np.log10(np.where(c > 0, seen, back[first] * p1[second]))
                base = np.log10((count + 1) / (uni.total + uni.kinds + 1))
                at = np.r_[0, np.cumsum(g.sizes)[:-1]]
                ids = pd.array(g.ids, dtype="Int64")
                ids[~g.known] = pd.NA
                yield pd.DataFrame({
                    "doc_id": ids, "held_out": g.held, "n_tokens": g.sizes,
                    "n_known": np.add.reduceat((count > 0)[g.word].astype(np.int64), at),
                    "base_score": np.add.reduceat(base[g.word], at), "score": np.add.reduceat(pair[which], at)})
    return run


def _by_group(replies: DataFrame, name: str) -> DataFrame:
    return (replies.where("kind = 0").groupBy("grp")
            .agg(F.collect_list(F.struct("part", "blob")).alias(name)))


def _counts(table: DataFrame) -> dict[int, int]:
    return {r["r"]: r["n"] for r in table.where("kind = 1").groupBy("r").agg(F.sum("n").alias("n")).collect()}


def katz_scores(docs: DataFrame, held: Column) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text) under the model of the rows outside ``held``."""
    spark = docs.sparkSession
    parts = partitions(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
                       F.col("doc_id").isNotNull().alias("known"), held.alias("held"),
                       F.coalesce("text", F.lit("")).alias("text"))
    packed = scratch(rows.mapInPandas(_groups, "kind int, grp long, first binary, second binary"), "lm-groups", by=("kind",))
    groups, words = (packed.where(F.col("kind") == k).drop("kind") for k in (0, 1))
    blob = "part int, grp long, blob binary"
    unigrams = scratch(words.mapInPandas(_send_words(parts), blob).groupBy("part")
                       .applyInPandas(_add_words(parts), OUT), "lm-unigrams", by=("kind",))
    release_part(packed, "kind=1")
    tidy(spark)
    n = _counts(unigrams)
    total, kinds = n.pop(0, 0), n.pop(-1, 0)
    uni = Unigrams.of(total, kinds, n)
    hot_from = max(1.0, total / HOT)
    numbered = groups.join(_by_group(unigrams, "words_in"), "grp")
    bigrams = scratch(numbered.mapInPandas(_send_pairs(parts, hot_from), blob).groupBy("part")
                      .applyInPandas(_add_pairs(uni), OUT), "lm-bigrams", by=("kind",))
    tidy(spark)
    d = discounts(_counts(bigrams))
    hot_sums = _hot_sums(bigrams)
    scored = numbered.join(_by_group(bigrams, "pairs_in"), "grp").mapInPandas(
        _score(parts, hot_from, uni, d, hot_sums), SCORES)
    return scored.withColumn("train_tokens", F.lit(int(total)).cast("long"))
