"""Whitening of embedding vectors by a bidiagonal qd solver.

1. Tasks add up integer vectors x = floor(scale * c) + offset: n and sums S, exact.
2. Tasks reduce blocks of centred rows by QR (the triangle of the blocks so far
   on top of the next block); triangles are combined 32 to a group until one,
   of d by d, is left.  Its bytes depend on the dimension alone.
3. The driver solves that triangle (``qd_solver``): Householder bidiagonal form,
   dqds for the singular values, twisted factorisations for the directions.
4. Tasks project the rows; sums of products of the projections, taken from the
   rows themselves, give ``identity_error``.

Defined results: rows whose vector is null or holds a null or a non-finite entry
are dropped; a shorter vector counts as padded by entries of 0; repeated rows
count each; a null id stays a null id; directions whose deviation is zero to
rounding (constant dimensions, a single row) are left out, so there may be fewer
components, or none; an empty table gives no rows.  An integer entry or a
deviation beyond 64 bits raises OverflowError.  Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tunelake.llm.qd_solver import principal

SCALE, OFFSET = 1024, 100_000
COMPONENTS = 8
BLOCK = 2048                 # rows of one QR step and of one output batch
FAN_IN = (1024, 32, 1)       # groups of each round that combines triangles


def finite_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, matrix of doubles) of the vectors without nulls and non-finite entries."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = np.flatnonzero(~np.asarray(column.is_null()))
    column = column.drop_null()
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(lengths)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))
    good = bad[ends] == bad[ends - lengths]
    d = int(lengths.max(initial=0))
    if (lengths == d).all():
        matrix = flat.reshape(len(lengths), d)
    else:
        matrix = np.zeros((len(lengths), d))
        matrix[np.arange(d) < lengths[:, None]] = flat
    return rows[good], matrix[good]


def integers(c: np.ndarray, d: int, scale: int, offset: int) -> np.ndarray:
    """floor(scale * c) + offset of rows padded to ``d`` entries."""
    x = np.floor(scale * c)
    if np.abs(x).max(initial=0.0) >= 2.0 ** 62:
        raise OverflowError("an entry does not fit into 64 bits")
    out = np.full((len(c), d), offset, np.int64)
    out[:, :c.shape[1]] += x.astype(np.int64)
    return out


def _sums(scale, offset):
    schema = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches):
        n, total = 0, np.zeros(0, np.int64)
        for b in batches:
            _, c = finite_rows(b.column(0))
            if len(c):
                d = max(c.shape[1], len(total))
                part = integers(c, d, scale, offset).sum(axis=0)
                total = np.concatenate((total, np.full(d - len(total), n * offset, np.int64))) + part
                n += len(c)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], pa.list_(pa.int64()))], schema=schema)
    return run


def moments(vectors: DataFrame, column: str, scale: int = SCALE, offset: int = OFFSET) -> tuple[int, list[int]]:
    """Number of the vectors and exact sum of each dimension."""
    parts = vectors.select(column).mapInArrow(_sums(scale, offset), "n long, sums array<long>")
    # A task that saw only shorter vectors has no sum for the last dimensions: its rows count as offsets there.
    rows = parts.select("n", F.posexplode("sums").alias("dim", "s")).groupBy("dim").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()  # one row for each dimension
    if not rows:
        return 0, []
    n = rows[0]["n"]
    return n, [r["s"] + (n - r["n"]) * offset for r in rows]


def _triangle(top: np.ndarray, block: np.ndarray) -> np.ndarray:
    return np.linalg.qr(np.vstack((top, block)), mode="r")


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n, from the exact numerator n * x - S."""
    mean = sums // n
    low = x - mean                      # small integers
    rest = sums - mean * n              # 0 <= rest < n
    return low - rest / n


def _triangles(n, sums, scale, offset):
    sums = np.asarray(sums, np.int64)
    d = len(sums)

    def run(batches):
        r = np.zeros((0, d))
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                _, c = finite_rows(b.column(0).slice(at, BLOCK))
                if len(c):
                    r = _triangle(r, _centred(integers(c, d, scale, offset), n, sums))
        if len(r):
            slot = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([r.tobytes()], pa.binary())],
                                             names=["slot", "r"])
    return run


def _combine(d):
    def run(frame):
        r = np.zeros((0, d))
        for blob in sorted(frame["r"]):
            r = _triangle(r, np.frombuffer(blob).reshape(-1, d))
        return frame.iloc[:1].assign(r=r.tobytes())
    return run


def triangle(vectors: DataFrame, column: str, n: int, sums: list[int], scale: int = SCALE,
             offset: int = OFFSET) -> np.ndarray:
    """Upper triangular R with R'R = sum of the outer products of the centred rows."""
    d = len(sums)
    parts = vectors.select(column).mapInArrow(_triangles(n, sums, scale, offset), "slot int, r binary")
    for groups in FAN_IN:
        parts = parts.withColumn("slot", F.col("slot") % groups).groupBy("slot").applyInPandas(
            _combine(d), "slot int, r binary")
    blob = parts.first()["r"]  # one row of d * d numbers
    r = np.frombuffer(blob).reshape(-1, d)
    return np.vstack((r, np.zeros((d - len(r), d)))) if len(r) < d else r


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """Sum over dimensions of (n * x - S)^2, exact."""
    bound = n * int(np.abs(x).max(initial=0)) + int(np.abs(sums).max(initial=0))
    if bound * bound * max(1, x.shape[1]) < 1 << 63:
        return ((n * x - sums) ** 2).sum(axis=1)
    wide = n * x.astype(object) - sums.astype(object)
    out = (wide * wide).sum(axis=1)
    if any(v >= 1 << 63 for v in out):
        raise OverflowError("a deviation does not fit into 64 bits")
    return out.astype(np.int64)


def _projection(n, sums, basis, scale, offset):
    """Centred rows times the whitening basis (d by k, columns already divided by their deviation)."""
    sums = np.asarray(sums, np.int64)

    def blocks(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows, c = finite_rows(part.column(part.num_columns - 1))
                if len(rows):
                    x = integers(c, len(sums), scale, offset)
                    yield part, rows, x, _centred(x, n, sums) @ basis
    return blocks


def _products(n, sums, basis, scale, offset):
    k = basis.shape[1]

    def run(batches):
        total = np.zeros(k + k * k)
        for _, _, _, y in _projection(n, sums, basis, scale, offset)(batches):
            total += np.concatenate((y.sum(axis=0), (y.T @ y).ravel()))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], names=["sums"])
    return run


def identity_error(vectors: DataFrame, column: str, n: int, sums: list[int], basis: np.ndarray,
                   scale: int = SCALE, offset: int = OFFSET) -> float:
    """Largest absolute entry of the projections' covariance minus the identity, from the projected rows."""
    k = basis.shape[1]
    parts = vectors.select(column).mapInArrow(_products(n, sums, basis, scale, offset), "sums array<double>")
    rows = parts.select(F.posexplode("sums").alias("i", "s")).groupBy("i").agg(F.sum("s").alias("s")).orderBy("i").collect()
    total = np.array([r["s"] for r in rows])
    mean = total[:k] / n
    return float(np.abs(total[k:].reshape(k, k) / n - np.outer(mean, mean) - np.eye(k)).max())


def _rows(n, sums, basis, explained, error, scale, offset, schema):
    k, exact = basis.shape[1], np.asarray(sums, np.int64)

    def run(batches):
        for part, rows, x, y in _projection(n, sums, basis, scale, offset)(batches):
            take = pa.array(np.repeat(rows, k))
            m = len(take)
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(take), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                pa.array(np.full(m, n, np.int64)), pa.array(np.repeat(_deviation(x, n, exact), k)),
                pa.array(y.ravel()), pa.array(np.tile(explained, len(rows))), pa.array(np.full(m, error))], schema=schema)
    return run


def whitened(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding", components: int = COMPONENTS,
             scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error), one row for each vector and component."""
    vectors = vectors.select(F.col(id_col), F.col(column))
    out = T.StructType([
        T.StructField(id_col, vectors.schema[id_col].dataType), T.StructField("component", T.IntegerType()),
        T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
        T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()),
        T.StructField("identity_error", T.DoubleType())])
    n, sums = moments(vectors, column, scale, offset)
    values, directions = (principal(triangle(vectors, column, n, sums, scale, offset), components)
                          if n and sums else (np.zeros(0), np.zeros((0, 0))))
    k = directions.shape[1]
    if k == 0:
        return vectors.sparkSession.createDataFrame([], out)
    basis = directions / np.sqrt(values[:k] / n)
    error = identity_error(vectors, column, n, sums, basis, scale, offset)
    return vectors.mapInArrow(_rows(n, sums, basis, values[:k] / values.sum(), error, scale, offset,
                                    to_arrow_schema(out)), out)
