"""Clipped n-gram overlaps of two token lists, inside the row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SLICE = 1024


def _numbered(columns: list[pa.Array]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row, token number) of the tokens of each column; equal tokens have equal numbers."""
    lengths = [pc.fill_null(pc.list_value_length(c), 0).to_numpy(zero_copy_only=False) for c in columns]
    flat = [c.flatten() for c in columns]
    number = pa.concat_arrays([f.cast(pa.string()) for f in flat]).dictionary_encode(null_encoding="encode").indices
    number, out, at = number.to_numpy(zero_copy_only=False).astype(np.int64), [], 0
    for n, f in zip(lengths, flat):
        out.append((np.repeat(np.arange(len(n)), n), number[at:at + len(f)]))
        at += len(f)
    return out


def _longer(sides, grams):
    """Numbers of the n-grams one token longer: equal (gram, next token) pairs get equal numbers."""
    keys, rows = [], []
    for (row, token), (gram_row, gram) in zip(sides, grams):
        shift = len(row) - len(gram)  # a gram and the token after it lie in one row, or there is no such gram
        n = max(len(gram) - 1, 0)
        same = gram_row[:n] == row[shift + 1:shift + 1 + n] if n else np.zeros(0, bool)
        pairs = np.column_stack((gram[:n], token[shift + 1:shift + 1 + n]))
        keys.append(np.where(same[:, None], pairs, -1))
        rows.append(np.where(same, gram_row[:n], -1))
    both = np.concatenate(keys)
    number = np.unique(both, axis=0, return_inverse=True)[1].reshape(-1) if len(both) else np.zeros(0, np.int64)
    return [(rows[0], number[:len(keys[0])]), (rows[1], number[len(keys[0]):])]


def _overlaps(pred: pa.Array, ref: pa.Array, orders: tuple) -> list[np.ndarray]:
    n, out = len(pred), []
    sides = _numbered([pred, ref])
    grams = sides
    for order in range(1, max(orders) + 1):
        if order > 1:
            grams = _longer(sides, grams)
        if order not in orders:
            continue
        width = int(max((g.max(initial=0) for _, g in grams), default=0)) + 1
        counts = [np.unique(r[r >= 0] * width + g[r >= 0], return_counts=True) for r, g in grams]
        common, i, j = np.intersect1d(counts[0][0], counts[1][0], assume_unique=True, return_indices=True)
        clipped = np.minimum(counts[0][1][i], counts[1][1][j])
        out.append(np.bincount(common // width, clipped, n).astype(np.int64))
    return out


def clipped_overlaps(pred_tokens: Column, ref_tokens: Column, orders: tuple = (1, 2)) -> Column:
    """Array of the clipped n-gram overlap of each of ``orders``; a null list has no tokens."""
    orders = tuple(orders)

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(pred: pa.Array, ref: pa.Array) -> pa.Array:
        parts = [_overlaps(pred.slice(at, SLICE), ref.slice(at, SLICE), orders) for at in range(0, len(pred), SLICE)]
        if not parts:
            return pa.array([], pa.list_(pa.int64()))
        rows = np.column_stack([np.concatenate([p[k] for p in parts]) for k in range(len(orders))])
        offsets = pa.array(np.arange(0, rows.size + 1, len(orders)), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel(), pa.int64()))
    return run(pred_tokens, ref_tokens)
