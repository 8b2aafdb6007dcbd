"""Model application over DataFrames.

User models and tokenizers are plain Python callables built by a factory
once per Python worker and fed Arrow batches; the data is partitioned and
moved by Spark only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_WORKER_CACHE: dict = {}


def _factory_key(prefix: str, factory) -> str:
    """Cache key of a factory: a hash of its pickled form, computed on the
    driver, so two different factories never share a worker-side object."""
    import hashlib

    from pyspark import cloudpickle
    return f"{prefix}:{hashlib.sha1(cloudpickle.dumps(factory)).hexdigest()}"


def _cached(key, factory):
    obj = _WORKER_CACHE.get(key)
    if obj is None:
        obj = _WORKER_CACHE[key] = factory()
    return obj


# -- U1: pluggable tokenizer -------------------------------------------------

def tokenizer_lengths(col: Column, factory: Callable[[], Callable[[str], list]], key: str = "tok") -> Column:
    """Token count of ``col`` under a user tokenizer (``factory()`` returns
    ``text -> tokens``), built once per worker; Arrow-batched."""
    key = _factory_key(key, factory)

    @F.pandas_udf(T.LongType())
    def _len(s: pd.Series) -> pd.Series:
        tok = _cached(key, factory)
        return pd.Series([None if x is None else len(tok(x)) for x in s], dtype="Int64")
    return _len(col)


def tokenizer_ids(col: Column, factory: Callable[[], Callable[[str], list]], key: str = "tok_ids") -> Column:
    """Token ids under a user tokenizer returning ints."""
    key = _factory_key(key, factory)

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def _ids(s: pd.Series) -> pd.Series:
        tok = _cached(key, factory)
        return pd.Series([None if x is None else [int(i) for i in tok(x)] for x in s])
    return _ids(col)


def word_punct_tokenizer():
    """A small deterministic tokenizer: runs of word characters, or single
    non-space symbols (Unicode aware)."""
    import regex
    pat = regex.compile(r"\w+|[^\w\s]")
    return lambda text: pat.findall(text)


# -- U2: batched model scoring ------------------------------------------------

SCORE_SCHEMA = "prediction string, loss double, num_tokens bigint"


def score_with_model(df: DataFrame, model_factory: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]],
                     keep: list[str], prompt: str = "prompt", reference: str = "reference",
                     key: str = "model") -> DataFrame:
    """Run a user model over every row with ``mapInPandas``.

    ``model_factory()`` returns ``f(batch) -> DataFrame[prediction, loss,
    num_tokens]`` for a pandas batch with ``prompt`` and ``reference``; it is
    built once per worker.  Batch size follows
    ``spark.sql.execution.arrow.maxRecordsPerBatch``.  Filters written before
    this call are pushed below it; filters after it are not.
    """
    out_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    out_schema = f"{out_schema}, {SCORE_SCHEMA}" if out_schema else SCORE_SCHEMA
    key = _factory_key(key, model_factory)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _cached(key, model_factory)
        for b in batches:
            res = model(b[[prompt, reference]])
            out = b[keep].reset_index(drop=True)
            out["prediction"] = res["prediction"].astype(object).values
            out["loss"] = res["loss"].astype("float64").values
            out["num_tokens"] = res["num_tokens"].astype("int64").values
            yield out
    cols = list(dict.fromkeys([*keep, prompt, reference]))
    return df.select(*cols).mapInPandas(run, out_schema)


def echo_model(max_new_tokens: int):
    """Deterministic stand-in model for tests and the registered query: the
    prediction repeats the first ``max_new_tokens`` words of the prompt; the
    loss is the share of reference words absent from the prompt (in nats,
    log1p), scored over the reference tokens."""
    def model(b: pd.DataFrame) -> pd.DataFrame:
        preds, losses, ntok = [], [], []
        for p, r in zip(b.iloc[:, 0], b.iloc[:, 1]):
            pw, rw = (p or "").split(), (r or "").split()
            preds.append(" ".join(pw[:max_new_tokens]))
            seen = set(pw)
            miss = sum(1 for w in rw if w not in seen)
            losses.append(float(np.log1p(miss / len(rw))) if rw else 0.0)
            ntok.append(len(rw))
        return pd.DataFrame({"prediction": preds, "loss": losses, "num_tokens": ntok})
    return model


# -- U3/U4: low-rank linear map ------------------------------------------------

def delta_weight(lora_a: np.ndarray, lora_b: np.ndarray, r: int, alpha: float) -> np.ndarray:
    """(alpha / r) * B @ A; scale 1.0 when r <= 0."""
    scale = alpha / r if r > 0 else 1.0
    return scale * (np.asarray(lora_b, dtype=np.float64) @ np.asarray(lora_a, dtype=np.float64))


def rule_matrix(rows: int, cols: int, a: int, b: int, mod: int, shift: int, scale: float) -> np.ndarray:
    """M[i][j] = ((a*i + b*j) mod m - shift) / scale -- a deterministic matrix
    that SQL can rebuild from the same rule."""
    i = np.arange(rows)[:, None]
    j = np.arange(cols)[None, :]
    return (((a * i + b * j) % mod) - shift) / float(scale)


def low_rank_projection(df: DataFrame, vec: str, keep: list[str], W: np.ndarray, A: np.ndarray,
                        B: np.ndarray, r: int, alpha: float) -> DataFrame:
    """Adds ``fused`` = (W + dW) x and ``two_step`` = W x + s * B (A x).

    The matrices are model weights of fixed shape (out x in, r x in, out x r),
    broadcast once; each Arrow batch is one numpy matmul.
    """
    spark = df.sparkSession
    fused_w = np.asarray(W, dtype=np.float64) + delta_weight(A, B, r, alpha)
    scale = alpha / r if r > 0 else 1.0
    bc = spark.sparkContext.broadcast((fused_w, np.asarray(W, np.float64), np.asarray(A, np.float64),
                                       np.asarray(B, np.float64), scale))
    keep_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    schema = f"{keep_schema}, fused array<double>, two_step array<double>"

    def run(batches):
        fw, w, a, b, s = bc.value
        for pdf in batches:
            x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]]) if len(pdf) else \
                np.zeros((0, w.shape[1]))
            fused = x @ fw.T
            two = x @ w.T + s * ((x @ a.T) @ b.T)
            out = pdf[keep].reset_index(drop=True)
            out["fused"] = list(fused)
            out["two_step"] = list(two)
            yield out
    return df.select(*keep, vec).mapInPandas(run, schema)


def projection_parity(proj: DataFrame, keep: list[str], tol: float = 1e-4) -> DataFrame:
    """max |fused - two_step| per row and whether it is below ``tol``."""
    diff = F.array_max(F.zip_with("fused", "two_step", lambda a, b: F.abs(a - b)))
    return proj.select(*keep, diff.alias("max_abs_diff"), (diff < tol).alias("parity_ok"))
