"""Helpers shared by the corpus operators: scratch tables and packed arrays.

Scratch tables live in the shared folder named by ``spark.checkpoint.dir``, so
every executor (and a restarted one) can read them; they replace
``checkpoint()`` where a compact columnar file is smaller than serialised rows.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import gc
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tunelake.session import apply_runtime_conf, ensure_checkpoint_dir, ship_package

# Words of every contract: runs without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

_LIVE: dict[str, SparkSession] = {}


def prepare(spark: SparkSession) -> None:
    """Shared folder known, package importable on the workers, Arrow batches of at most 1024 whole texts."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    apply_runtime_conf(spark)


def scratch(df: DataFrame, name: str, by: tuple = ()) -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder, partitioned ``by``, and read it back.

    The table holds whole results, survives lost executors and cuts lineage.
    It is removed by :func:`release` or when the driver exits.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm-{name}-{uuid.uuid4().hex[:12]}"
    df.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    _LIVE[path] = spark
    return out


def tidy(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of finished steps: it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def release(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_scratch_path", None)
        spark = _LIVE.pop(path, None)
        if spark is not None:
            _delete(spark, path)


def release_part(table: DataFrame, part: str) -> None:
    """Delete one partition folder (``kind=1``) of a scratch table."""
    path = getattr(table, "_scratch_path", None)
    if path in _LIVE:
        _delete(_LIVE[path], f"{path}/{part}")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _release_all() -> None:
    for path, spark in list(_LIVE.items()):
        try:
            _delete(spark, path)
        except Exception:  # the session is gone: the cluster's folder policy applies
            return


def partitions(spark: SparkSession) -> int:
    """Reduce-side width: the operator of the cluster sets it with the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def read_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def unsent(df: DataFrame) -> DataFrame:
    """A side of a join whose other side is not to be broadcast either: both are sorted and merged.

    Spark takes a table for small by its compressed files, and an explode or a step in Python for as long as
    its input; once a broadcast is planned, it stays, whatever the rows are found to be.
    """
    return df.hint("merge")


def held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id written in decimal, modulo; a null id counts as empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus) == remainder


def others_packed(fn):
    """For functions (docs, ...) -> rows of docs with their columns: what is not doc_id, text or n_chars
    travels in one struct, so a caller's column can have any name."""
    @functools.wraps(fn)
    def run(docs: DataFrame, *args, **kw) -> DataFrame:
        core = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
        others = [c for c in docs.columns if c not in core]
        if not others:
            return fn(docs, *args, **kw)
        packed = docs.select(*core, F.struct(*[F.col(f"`{c}`") for c in others]).alias("_others"))
        out = fn(packed, *args, **kw)
        return out.select(*[F.col(c) if c in core else F.col("_others").getField(c).alias(c) for c in docs.columns])
    return run


def give_back() -> None:
    """Return a worker's freed memory to the system: workers live on, and the next stage needs it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # only the GNU library has it
        return


@contextmanager
def no_collector():
    """For steps that make very many small objects and no cycles: the collector would walk over them again and again."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


# --- bounded batches ----------------------------------------------------------

PACKED = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("blob", pa.binary())])


def in_slices(fn, schema: pa.Schema = PACKED, rows: int = 256):
    """``fn`` (an iterator of frames to an iterator of frames) for mapInArrow, fed ``rows`` rows at a time.

    Only a slice of an Arrow batch becomes Python objects at once, so memory
    doesn't follow the session's batch size.
    """
    def run(batches):
        give_back()
        slices = (b.slice(i, rows).to_pandas() for b in batches for i in range(0, b.num_rows, rows))
        for frame in fn(slices):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)
    return run


# --- packed arrays -----------------------------------------------------------

def pack(*arrays: np.ndarray) -> bytes:
    """Arrays to one compressed blob: byte planes, so high bytes cost little."""
    parts = [np.int64(len(arrays)).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a)
        head = f"{a.dtype.str}:{a.size}".encode().ljust(24)
        planes = a.view(np.uint8).reshape(a.size, a.dtype.itemsize).T if a.size else np.zeros(0, np.uint8)
        parts += [head, np.ascontiguousarray(planes).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for _ in range(n):
        kind, size = raw[at:at + 24].decode().split(":")
        dtype, size = np.dtype(kind), int(size)
        nbytes = dtype.itemsize * size
        planes = np.frombuffer(raw, np.uint8, nbytes, at + 24).reshape(dtype.itemsize, size)
        out.append(np.ascontiguousarray(planes.T).view(dtype).reshape(size))
        at += 24 + nbytes
    return out


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    return np.diff(sorted_values, prepend=sorted_values.dtype.type(0))


def undeltas(d: np.ndarray) -> np.ndarray:
    return np.cumsum(d, dtype=d.dtype)
