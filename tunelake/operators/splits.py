"""Deterministic shuffles and splits.

All use a hash of ``seed:id`` rather than ``rand(seed)`` so the result does
not depend on how the data happens to be partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.operators.segmented import global_position, next_value

# Seed and buffer of the reference's shuffle and the configured split ratios.
DEFAULT_SEED = 42
DEFAULT_BUFFER = 10_000
DEFAULT_SPLITS = (("train", 0.90), ("validation", 0.05), ("test", 0.05))


def shuffle_key(id_col: str, seed: int = DEFAULT_SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def seeded_shuffle(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED,
                   name: str = "position") -> DataFrame:
    """Adds ``shuffle_key`` and the 0-based ``position`` in the shuffled order."""
    keyed = df.withColumn("shuffle_key", shuffle_key(id_col, seed))
    return global_position(keyed, ["shuffle_key", id_col], name=name)


def hash_bucket(id_col: str, seed: int = DEFAULT_SEED, buckets: int = 10000) -> Column:
    """Stable bucket in [0, buckets) from the first 32 bits of md5(seed:id)."""
    h = F.conv(F.substring(shuffle_key(id_col, seed), 1, 8), 16, 10).cast("bigint")
    return (h % F.lit(buckets)).cast("bigint")


def hash_split(df: DataFrame, id_col: str, seed: int = DEFAULT_SEED,
               splits=DEFAULT_SPLITS, buckets: int = 10000) -> DataFrame:
    """Adds ``bucket`` and ``split``: bucket ranges proportional to the ratios."""
    b = hash_bucket(id_col, seed, buckets)
    out = df.withColumn("bucket", b)
    edge, expr = 0, None
    for name, frac in splits[:-1]:
        edge += int(round(frac * buckets))
        cond = F.col("bucket") < edge
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    last = F.lit(splits[-1][0])
    return out.withColumn("split", expr.otherwise(last) if expr is not None else last)


def buffer_slot(id_col: str, buffer_size: int = DEFAULT_BUFFER, seed: int = DEFAULT_SEED) -> Column:
    """Slot of a row in the shuffle buffer."""
    return hash_bucket(id_col, seed, buffer_size)


def buffer_shuffle(df: DataFrame, id_col: str, order: list[str] | None = None, buffer_size: int = DEFAULT_BUFFER,
                   seed: int = DEFAULT_SEED) -> DataFrame:
    """A shuffle with a buffer of ``buffer_size`` slots, as a batch.

    Rows arrive in ``order`` (default: the id; unique).  Each takes the slot that a
    hash of seed and id names and pushes out the row held there; what is left at
    the end comes out by hash.  Adds ``pushed_by`` (the id of the row that pushed
    this one out, null for what is left), ``shuffle_key`` and the 0-based ``position``
    in the output.  ``streaming.stateful.shuffle_stream`` gives the same order.
    """
    order = order or [id_col]
    slots = df.where(F.col(id_col).isNotNull()) \
              .withColumn("_slot", buffer_slot(id_col, buffer_size, seed)) \
              .withColumn("_arrival", F.struct(*[F.col(c) for c in order], F.col(id_col).alias("_id")))
    nxt = next_value(slots, ["_slot"], ["_arrival"], "_arrival", "_next")
    keyed = nxt.withColumn("pushed_by", F.col("_next._id")).withColumn("shuffle_key", shuffle_key(id_col, seed))
    placed = global_position(keyed, [F.col("_next").isNull(), F.col("_next"), F.col("shuffle_key"), F.col(id_col)])
    return placed.drop("_slot", "_arrival", "_next")


def pushed_order(id_col: str, pushed_ts: str = "pushed_ts") -> list[Column]:
    """The order of the rows of ``streaming.stateful.shuffle_stream``."""
    return [F.col("pushed_by").isNull(), F.col(pushed_ts), F.col("pushed_by"), F.col("shuffle_key"), F.col(id_col)]
