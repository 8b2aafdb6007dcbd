"""Quality by attention over passages (multiple-instance learning).

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
from surface features, a gated attention unit (tanh times sigmoid) weighs it
against the others of its document, and the weighted mean of the encodings is
judged.  Only document labels are needed: what passages matter is learned.

The network has under two thousand weights.  It is fitted in one task on a
bounded, balanced sample of labelled rows (``PER_CLASS`` of each class) and
sent to every task; scoring is row-local over all passages of whole texts.

Cases: null and empty texts are one empty passage; without rows of both
classes the score is the share of label 1 (0.0 without any); repeated rows are
scored one by one; an empty table gives an empty table; extra columns are
ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tunelake.llm.common import held_out, others_packed, pack, unpack
from tunelake.llm.labelled import labelled_sample

PASSAGE = 64
HIDDEN, GATE = 16, 8
PER_CLASS = 3000
EPOCHS, RATE, BATCH, DECAY = 30, 0.01, 64, 1e-4

SYMBOLS, ENDS, DIGITS = b"#*$%&|<>{}[]\\^~=_@", b".!?", b"0123456789"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
OTHER = bytes(range(128, 256))
FEATURES = 14


def _without(raw: bytes, drop: bytes) -> int:
    return len(raw) - len(raw.translate(None, drop))


def passage_features(text: str) -> np.ndarray:
    """One row for each passage of the text (at least one)."""
    words = text.encode().split()
    out = []
    for at in range(0, len(words), PASSAGE):
        p = words[at:at + PASSAGE]
        raw = b" ".join(p)
        n, size = len(p), max(1, len(raw))
        kinds = len(set(p))
        marks = _without(raw, SYMBOLS)
        out.append((
            np.log1p(n), (size - n + 1) / n, kinds / n, sum(map(bytes.__eq__, p, p[1:])) / n,
            marks / n, marks / size, _without(raw, ENDS) / n, raw.count(b",") / n, _without(raw, DIGITS) / size,
            _without(raw, UPPER) / n, _without(raw, OTHER) / size, raw.count(b"|") / n,
            max(map(len, p)) / 64, min(1.0, len(words) / 50),
        ))
    return np.asarray(out or [(0.0,) * FEATURES], np.float64)


SHAPES = {"W": (FEATURES, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "U": (HIDDEN, GATE), "a": (GATE,),
          "c": (HIDDEN,), "d": (1,)}


@dataclass
class Network:
    mean: np.ndarray
    scale: np.ndarray
    p: dict

    def forward(self, x: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> dict:
        """x: passages of consecutive bags; at: first passage of each bag."""
        p = self.p
        x = (x - self.mean) / self.scale
        h = np.tanh(x @ p["W"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-np.clip(h @ p["U"], -30, 30)))
        e = (t * s) @ p["a"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, at), sizes))
        weight = e / np.repeat(np.add.reduceat(e, at), sizes)
        z = np.add.reduceat(weight[:, None] * h, at)
        return {"x": x, "h": h, "t": t, "s": s, "weight": weight, "z": z,
                "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -35, 35)))}

    def gradients(self, f: dict, at, sizes, err: np.ndarray) -> dict:
        """Of the weighted logistic loss; err: (y - label) * weight of each bag."""
        p, owner = self.p, np.repeat(np.arange(len(at)), sizes)
        d_z = err[:, None] * p["c"]
        d_h = f["weight"][:, None] * d_z[owner]
        d_w = (f["h"] * d_z[owner]).sum(1)
        d_e = f["weight"] * (d_w - np.add.reduceat(f["weight"] * d_w, at)[owner])
        gate = f["t"] * f["s"]
        d_gate = d_e[:, None] * p["a"]
        d_t, d_s = d_gate * f["s"] * (1 - f["t"] ** 2), d_gate * f["t"] * f["s"] * (1 - f["s"])
        d_h = (d_h + d_t @ p["V"].T + d_s @ p["U"].T) * (1 - f["h"] ** 2)
        return {"W": f["x"].T @ d_h, "b": d_h.sum(0), "V": f["h"].T @ d_t, "U": f["h"].T @ d_s, "a": gate.T @ d_e,
                "c": f["z"].T @ err, "d": np.array([err.sum()])}


def fit_network(bags: list[np.ndarray], y: np.ndarray, seed: int = 5) -> Network:
    """Adam on the logistic loss; classes weigh the same."""
    rng = np.random.default_rng(seed)
    rate1 = float(y.mean()) if len(y) else 0.0
    if not 0 < rate1 < 1:
        p = {k: np.zeros(s) for k, s in SHAPES.items()}
        p["d"][0] = 35.0 if rate1 else -35.0
        return Network(np.zeros(FEATURES), np.ones(FEATURES), p)
    every = np.concatenate(bags)
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "ac" else np.zeros(s) for k, s in SHAPES.items()}
    net = Network(every.mean(0), every.std(0) + 1e-3, p)
    m, v, step = {k: 0.0 for k in p}, {k: 0.0 for k in p}, 0
    weight = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum())) * len(y)
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for k in range(0, len(y), BATCH):
            some = order[k:k + BATCH]
            x, sizes = np.concatenate([bags[i] for i in some]), np.asarray([len(bags[i]) for i in some])
            at = np.r_[0, np.cumsum(sizes)[:-1]]
            f = net.forward(x, at, sizes)
            grads = net.gradients(f, at, sizes, (f["y"] - y[some]) * weight[some] / len(some))
            step += 1
            for name, g in grads.items():
                g = g + DECAY * p[name]
                m[name] = 0.9 * m[name] + 0.1 * g
                v[name] = 0.999 * v[name] + 0.001 * g * g
                p[name] = p[name] - RATE * (m[name] / (1 - 0.9 ** step)) / (
                    np.sqrt(v[name] / (1 - 0.999 ** step)) + 1e-8)
            net.p = p
    return net


def train(sample: DataFrame) -> Network:
    """Fit on (doc_id, text, label) rows: passages are encoded where they lie, one task fits."""
    def encoded(batches):
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"],
                                "bag": [pack(passage_features(t).astype(np.float32).ravel()) for t in b["text"]]})

    def fitted(batches):
        frames = [b for b in batches if len(b)]
        data = pd.concat(frames).sort_values(["doc_id", "bag"]) if frames else pd.DataFrame({"bag": [], "label": []})
        bags = [unpack(x)[0].astype(np.float64).reshape(-1, FEATURES) for x in data["bag"]]
        net = fit_network(bags, data["label"].to_numpy(np.int64))
        yield pd.DataFrame({"model": [pack(net.mean, net.scale, *[net.p[k].ravel() for k in SHAPES])]})

    rows = sample.select("doc_id", "label", "text").mapInPandas(encoded, "doc_id long, label int, bag binary")
    got = rows.repartition(1).mapInPandas(fitted, "model binary").first()
    if got is None:
        return fit_network([], np.zeros(0))
    mean, scale, *weights = unpack(bytes(got["model"]))
    return Network(mean, scale, {k: w.reshape(s) for (k, s), w in zip(SHAPES.items(), weights)})


def scores(net: Network, texts: list[str]) -> np.ndarray:
    out = []
    for k in range(0, len(texts), 256):
        bags = [passage_features(t) for t in texts[k:k + 256]]
        sizes = np.asarray([len(x) for x in bags])
        out.append(net.forward(np.concatenate(bags), np.r_[0, np.cumsum(sizes)[:-1]], sizes)["y"])
    return np.concatenate(out) if out else np.zeros(0)


def with_score(docs: DataFrame, net: Network, name: str = "score", text: str = "text") -> DataFrame:
    """``docs`` with the quality score of ``text``; a column of that name is replaced."""
    @F.pandas_udf(DoubleType())
    def judged(t: pd.Series) -> pd.Series:
        return pd.Series(scores(net, t.tolist()))

    return docs.withColumn(name, judged(F.coalesce(F.col(text), F.lit(""))))


def quality(docs: DataFrame, labels: DataFrame, held: Column | None = None, threshold: float = 0.3,
            per_class: int = PER_CLASS) -> DataFrame:
    """Score ``docs`` with a network fitted on the labels outside ``held``."""
    held = held_out(F.col("doc_id"), 5, 0) if held is None else held
    net = train(labelled_sample(docs, labels, "quality", ~held, per_class))
    return with_score(docs.select("doc_id", "text"), net).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@others_packed
def accepted(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with their columns."""
    net = train(labelled_sample(docs, labels, "quality", ~held_out(F.col("doc_id"), 5, 0), per_class))
    return with_score(docs, net, "_passage_score").where(F.col("_passage_score") >= threshold).select(*docs.columns)
