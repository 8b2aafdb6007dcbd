"""Toxicity: a factorization machine over hashed terms.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), x_i = 1 if a
term of the text falls into bucket i.  The factors learn pairs (an insult and
a group mention together) that a sum of single weights can't express.  It is
fitted once on a bounded, balanced sample of labelled rows (``PER_CLASS`` of
each class) in one task.  Every bucket that occurs in the sample has a weight
and factors, however rare; an L1 penalty, the same in each epoch for rare and
frequent terms, holds back what the label doesn't bear out.  The model has at most BUCKETS * (1 + FACTORS) single-precision numbers
and is broadcast.  Scoring is row-local over whole texts.

Cases: null and empty texts have no terms and score sigmoid(w0); without rows
of both classes the score is the share of label 1 (0.0 without any); repeated
rows are scored one by one; an empty table gives an empty table; extra columns
are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tunelake.llm.common import held_out, pack, unpack
from tunelake.llm.labelled import labelled_sample

BUCKETS = 1 << 20
FACTORS = 8
PER_CLASS = 4000
EPOCHS, BATCH = 50, 64
RATE, FACTOR_RATE = 4.0, 0.05      # of the first epoch; they fall to zero
SPARSE, FACTOR_SPARSE, DECAY = 5e-4, 1e-3, 1e-3
CACHE_TERMS = 500_000
TERM = re.compile(r"\w+")
STEM = 5


def term_buckets(text: str, cache: dict) -> np.ndarray:
    """Distinct buckets of a text's terms: its words, and the stems of the longer ones."""
    terms = set(TERM.findall(text.lower()))
    terms.update(["^" + t[:STEM] for t in terms if len(t) > STEM])
    new = terms.difference(cache)
    if new:
        if len(cache) > CACHE_TERMS:
            cache.clear()
            new = terms
        for t in new:
            cache[t] = zlib.crc32(t.encode()) & (BUCKETS - 1)
    return np.unique(np.fromiter((cache[t] for t in terms), np.int64, len(terms)))


@dataclass
class Machine:
    buckets: np.ndarray   # buckets of the sample, ascending
    bias: float
    weights: np.ndarray
    factors: np.ndarray   # buckets x FACTORS

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        """Margin of each row of positions in ``buckets``."""
        sizes = np.asarray([len(r) for r in rows])
        out = np.full(len(rows), self.bias)
        full = np.flatnonzero(sizes)
        if len(full):
            flat = np.concatenate([rows[i] for i in full])
            at = np.r_[0, np.cumsum(sizes[full])[:-1]]
            v = self.factors[flat]
            s = np.add.reduceat(v, at)
            out[full] += np.add.reduceat(self.weights[flat], at) + 0.5 * (
                (s * s).sum(1) - np.add.reduceat((v * v).sum(1), at))
        return out

    def position(self, buckets: np.ndarray) -> np.ndarray:
        if not len(self.buckets):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.buckets, buckets), len(self.buckets) - 1)
        return at[self.buckets[at] == buckets]


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def shrunk(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Values drawn to zero (proximal step of L1)."""
    return np.sign(x) * np.maximum(np.abs(x) - by, 0)


def fit_machine(rows: list[np.ndarray], y: np.ndarray, seed: int = 7) -> Machine:
    """Proximal AdaGrad on the logistic loss; classes weigh the same.

    A bucket pays its penalties when a batch has it, for the batches since then
    too (``gap``, their mean number).
    """
    rate1 = float(y.mean()) if len(y) else 0.0
    if not 0 < rate1 < 1:
        # sigmoid(+-35) is 1 or 0 to the last bit that counts.
        return Machine(np.zeros(0, np.int64), 35.0 if rate1 else -35.0, np.zeros(0), np.zeros((0, FACTORS)))
    known = np.unique(np.concatenate(rows).astype(np.int64))
    n1, n0 = y.sum(), len(y) - y.sum()
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    rng = np.random.default_rng(seed)
    n = len(known)
    m = Machine(known, 0.0, np.zeros(n, np.float32), rng.normal(0, 0.01, (n, FACTORS)).astype(np.float32))
    local = [m.position(r) for r in rows]
    batches = -(-len(y) // BATCH)
    gap = (batches / np.minimum(np.bincount(np.concatenate(local), minlength=n), batches)).astype(np.float32)
    g_b, g_w, g_v = 1e-6, np.ones(n, np.float32), np.ones((n, FACTORS), np.float32)
    for epoch in range(EPOCHS):
        rate, factor_rate = (r * (1 - epoch / EPOCHS) for r in (RATE, FACTOR_RATE))
        order = rng.permutation(len(y))
        for at in range(0, len(y), BATCH):
            some = order[at:at + BATCH]
            part = [local[i] for i in some]
            err = ((sigmoid(m.margins(part)) - y[some]) * weight[some] / len(some)).astype(np.float32)
            d_b = float(err.sum())
            g_b += d_b * d_b
            m.bias -= rate * d_b / g_b ** 0.5
            sizes = np.asarray([len(p) for p in part])
            flat, owner = np.concatenate(part), np.repeat(np.arange(len(some)), sizes)
            if not len(flat):
                continue
            s = np.zeros((len(some), FACTORS), np.float32)
            s[sizes > 0] = np.add.reduceat(m.factors[flat], (np.cumsum(sizes) - sizes)[sizes > 0])
            by = np.argsort(flat, kind="stable")
            flat, owner = flat[by], owner[by]
            cut = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
            touched = flat[cut]
            w, v, since = m.weights[touched], m.factors[touched], gap[touched]
            d_w = np.add.reduceat(err[owner], cut)
            d_v = np.add.reduceat(err[owner][:, None] * (s[owner] - m.factors[flat]), cut) + DECAY * since[:, None] * v
            g_w[touched] += d_w * d_w
            g_v[touched] += d_v * d_v
            h = rate / np.sqrt(g_w[touched])
            m.weights[touched] = shrunk(w - h * d_w, h * SPARSE * since)
            h = factor_rate / np.sqrt(g_v[touched])
            m.factors[touched] = shrunk(v - h * d_v, h * FACTOR_SPARSE * since[:, None])
    return m


def train(sample: DataFrame) -> Machine:
    """Fit on (text, label) rows: terms are hashed where they lie, one task fits."""
    def hashed(batches):
        cache: dict = {}
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"],
                                "terms": [pack(term_buckets(t, cache).astype(np.int32)) for t in b["text"]]})

    def fitted(batches):
        frames = [b for b in batches if len(b)]
        data = pd.concat(frames).sort_values(["doc_id", "terms"]) if frames else pd.DataFrame({"terms": [], "label": []})
        m = fit_machine([unpack(t)[0] for t in data["terms"]], data["label"].to_numpy(np.int64))
        yield pd.DataFrame({"model": [pack(m.buckets, np.array([m.bias]), m.weights, m.factors.ravel())]})

    rows = sample.select("doc_id", "label", "text").mapInPandas(hashed, "doc_id long, label int, terms binary")
    got = rows.repartition(1).mapInPandas(fitted, "model binary").first()
    if got is None:
        return fit_machine([], np.zeros(0))
    buckets, bias, weights, factors = unpack(bytes(got["model"]))
    return Machine(buckets, float(bias[0]), weights, factors.reshape(-1, FACTORS))


def score(docs: DataFrame, machine: Machine, text: str = "text") -> DataFrame:
    """(doc_id, score) of every row."""
    cache: dict = {}
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf(DoubleType())
    def judged(texts: pd.Series) -> pd.Series:
        known = sent.value
        return pd.Series(sigmoid(known.margins([known.position(term_buckets(t, cache)) for t in texts])))

    return docs.select("doc_id", judged(F.coalesce(F.col(text), F.lit(""))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, held: Column | None = None, threshold: float = 0.7,
             per_class: int = PER_CLASS) -> DataFrame:
    """Score ``docs`` with a machine fitted on the labels outside ``held``."""
    held = held_out(F.col("doc_id"), 3, 1) if held is None else held
    machine = train(labelled_sample(docs, labels, "toxic", ~held, per_class))
    return score(docs, machine).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
