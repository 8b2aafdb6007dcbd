"""Per-group running windows that stay balanced when one group is huge.

A plain ``Window.partitionBy(run).orderBy(step)`` sends every row of a run
to one task.  If one run holds a third of all rows that task becomes the
whole job.  The helpers here split each group into *blocks*:

1. ``repartitionByRange(n, *keys, *order)`` cuts the global (keys, order)
   order into ``n`` contiguous, similarly sized ranges; a hot key spans many
   of them.  The range id (``spark_partition_id``) becomes the block id.
2. The window runs per (keys, block): every task is bounded by ~rows/n.
3. Per (keys, block) totals are aggregated (small) and combined over the
   earlier blocks of the same key with a window over the *block table*
   (at most ``n`` rows for any key).
4. Only blocks whose key also appears in an earlier block need a
   correction, and there is at most one such (key, block) per block: the
   first key of each range.  That table has <= n rows, a proven bound, so it
   is broadcast back.

The result does not depend on where the ranges are cut: a sum of doubles is
kept as integer sums of its digits (``exact_sums``), everything else is
integer or a comparison.  There is no other path for small groups.

The block-tagged frame is written once with a reliable ``checkpoint()`` (to
the shared folder named by ``spark.checkpoint.dir``).  This is required for
correctness, not only for speed: the window branch and the block-total
branch would otherwise each plan their own range exchange, and Spark seeds
the range sampler with the RDD id, so the two would cut the ranges at
different places.  The checkpoint also cuts the lineage, so a lost executor
re-reads the blocks instead of re-running the scan and the range shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.operators import exact_sums
from tunelake.session import cut_lineage

_BLK = "_tl_blk"


BLOCK_BYTES = 128 << 20


def _n_blocks(df: DataFrame, n_blocks: int | None) -> int:
    """As many ranges as the session has shuffle partitions, and more if the inputs, by Spark's own
    estimate of their bytes, would make ranges larger than ``BLOCK_BYTES``."""
    if n_blocks:
        return int(n_blocks)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [_leaf_bytes(df, leaves.apply(i)) for i in range(leaves.size())]
    return max(least, -(-sum(s for s in sizes if s < 1 << 60) // BLOCK_BYTES))  # beyond: Spark has no estimate


def _leaf_bytes(df: DataFrame, leaf) -> int:
    """Spark's estimate; of a checkpoint the bytes of its files, as Spark keeps the estimate of the plan
    that was cut off, and takes a join for the product of its sides."""
    if leaf.getClass().getSimpleName() == "LogicalRDD":
        file = leaf.rdd().getCheckpointFile()
        if file.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(file.get())
            return int(path.getFileSystem(sc._jsc.hadoopConfiguration()).getContentSummary(path).getLength())
    return int(str(leaf.stats().sizeInBytes()))


def _order_cols(order):
    return [F.col(c) if isinstance(c, str) else c for c in order]


def with_blocks(df: DataFrame, keys: list[str], order: list, n_blocks: int | None = None) -> DataFrame:
    """Range-partition on (keys, order) and tag each row with its range id."""
    n = _n_blocks(df, n_blocks)
    tagged = df.repartitionByRange(n, *[F.col(k) for k in keys], *_order_cols(order)) \
               .withColumn(_BLK, F.spark_partition_id())
    return cut_lineage(tagged)


def _with_block_values(rows: DataFrame, values: DataFrame, keys: list[str]) -> DataFrame:
    """Left join of the (keys, block) table, at most one row for each block; a null key is a key."""
    renamed = values.select(*[F.col(k).alias(f"_tl_k{i}") for i, k in enumerate(keys)], F.col(_BLK).alias("_tl_kb"),
                            *[c for c in values.columns if c not in (*keys, _BLK)])
    same = F.col(_BLK) == F.col("_tl_kb")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_tl_k{i}"))
    return rows.join(F.broadcast(renamed), same, "left")


_COMBINE = {
    "sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)),
    "min": lambda a, b: F.least(a, b),
    "max": lambda a, b: F.greatest(a, b),
}
_AGG = {"sum": F.sum, "count": F.count, "min": F.min, "max": F.max}


def running_aggregates(df: DataFrame, keys: list[str], order: list,
                       specs: dict[str, tuple[str, Column, bool]],
                       n_blocks: int | None = None) -> DataFrame:
    """Add running aggregates per group in ``order``.

    ``specs`` maps an output name to ``(fn, column, inclusive)`` with ``fn`` in
    sum / count / min / max; ``inclusive=False`` excludes the current row
    (frame ``unboundedPreceding .. -1``).  Exclusive results of the first row of
    a group are null (``count`` and ``sum`` give 0 after the combine step only
    when an earlier block contributed; a group's very first row stays null for
    min/max and 0 for count).
    """
    b = with_blocks(df, keys, order, n_blocks)
    part = [F.col(k) for k in keys] + [F.col(_BLK)]
    w_incl = Window.partitionBy(*part).orderBy(*_order_cols(order)) \
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_excl = Window.partitionBy(*part).orderBy(*_order_cols(order)) \
        .rowsBetween(Window.unboundedPreceding, -1)
    valued = b.withColumns({f"_tl_val_{name}": col for name, (_fn, col, _inclusive) in specs.items()})
    doubles = [name for name, (fn, _c, _i) in specs.items()
               if fn == "sum" and isinstance(valued.schema[f"_tl_val_{name}"].dataType, (T.DoubleType, T.FloatType))]
    digits = exact_sums.plan(valued, [f"_tl_val_{name}" for name in doubles])
    parts: dict[str, tuple[str, bool]] = {}  # column that is aggregated -> (fn, inclusive)
    places = []
    for name, (fn, _c, inclusive) in specs.items():
        d = digits.get(f"_tl_val_{name}")
        if d is None:
            parts[name] = (fn, inclusive)
            continue
        for i, digit in enumerate(d.split(F.col(f"_tl_val_{name}"))):
            places.append(digit.alias(f"_tl_val_{name}__{i}"))
            parts[f"{name}__{i}"] = ("sum", inclusive)
    valued = valued.select("*", *places)
    local = valued.select("*", *[
        _AGG[fn](F.col(f"`_tl_val_{name}`")).over(w_incl if inclusive else w_excl).alias(f"_tl_loc_{name}")
        for name, (fn, inclusive) in parts.items()])

    # Block totals per (keys, block): one row per key per range.
    totals = local.groupBy(*keys, _BLK).agg(
        *[_AGG[fn](F.col(f"`_tl_val_{name}`")).alias(f"_tl_tot_{name}") for name, (fn, _i) in parts.items()])
    w_blocks = Window.partitionBy(*keys).orderBy(_BLK) \
        .rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(
        *keys, _BLK,
        F.count(F.lit(1)).over(w_blocks).alias("_tl_earlier"),
        *[_AGG["sum" if fn == "count" else fn](F.col(f"`_tl_tot_{name}`")).over(w_blocks)
          .alias(f"_tl_pre_{name}") for name, (fn, _i) in parts.items()])
    # Only the first key of a range can continue from earlier ranges:
    # at most n_blocks rows, so the broadcast is bounded by the block count.
    corrections = prefix.where(F.col("_tl_earlier") > 0).drop("_tl_earlier")
    out = _with_block_values(local, corrections, keys)

    def combined(name, fn):
        loc, pre = F.col(f"`_tl_loc_{name}`"), F.col(f"`_tl_pre_{name}`")
        if fn not in ("sum", "count"):
            return _COMBINE[fn](loc, pre)
        val = F.when(pre.isNull(), loc).otherwise(_COMBINE[fn](loc, pre))
        return F.coalesce(val, F.lit(0)).cast("bigint") if fn == "count" else val
    results = {}
    for name, (fn, _c, _i) in specs.items():
        d = digits.get(f"_tl_val_{name}")
        results[name] = combined(name, fn) if d is None else d.join([combined(f"{name}__{i}", "sum") for i in range(d.columns)])
    kept = [F.col(f"`{c}`") for c in out.columns if not c.startswith("_tl_") and c not in results]
    return out.select(*kept, *[c.alias(name) for name, c in results.items()])


def row_ordinal(df: DataFrame, keys: list[str], order: list, name: str = "ordinal",
                n_blocks: int | None = None) -> DataFrame:
    """1-based position of each row inside its group (``row_number``), skew-safe.

    ``order`` must be unique within a group for the result to be deterministic.
    """
    return running_aggregates(df, keys, order, {name: ("count", F.lit(1), True)}, n_blocks)


def previous_value(df: DataFrame, keys: list[str], order: list, col: str, name: str,
                   n_blocks: int | None = None) -> DataFrame:
    """``lag(col)`` per group in ``order`` without a single-task window per group."""
    return _neighbour(df, keys, order, col, name, n_blocks, F.lag, F.max_by)


def next_value(df: DataFrame, keys: list[str], order: list, col: str, name: str,
               n_blocks: int | None = None) -> DataFrame:
    """``lead(col)`` per group in ``order`` without a single-task window per group."""
    return _neighbour(df, keys, order, col, name, n_blocks, F.lead, F.min_by)


def _neighbour(df, keys, order, col, name, n_blocks, shift, edge_by):
    b = with_blocks(df, keys, order, n_blocks)
    part = [F.col(k) for k in keys] + [F.col(_BLK)]
    w = Window.partitionBy(*part).orderBy(*_order_cols(order))
    local = b.withColumn("_tl_near", shift(F.col(col)).over(w)) \
             .withColumn("_tl_edge", shift(F.lit(1)).over(w).isNull())
    # The value at the edge of each (key, block), then that of the nearest block of the same key.
    edge = local.groupBy(*keys, _BLK).agg(edge_by(F.col(col), F.struct(*_order_cols(order))).alias("_tl_value"))
    w_blocks = Window.partitionBy(*keys).orderBy(_BLK)
    carry = edge.select(*keys, _BLK, shift("_tl_value").over(w_blocks).alias("_tl_carry"),
                        shift(F.lit(1)).over(w_blocks).alias("_tl_has")) \
                .where(F.col("_tl_has").isNotNull()).drop("_tl_has")
    out = _with_block_values(local, carry, keys)
    out = out.withColumn(name, F.when(F.col("_tl_edge"), F.col("_tl_carry")).otherwise(F.col("_tl_near")))
    return out.drop(*[c for c in out.columns if c.startswith("_tl_")])


def global_position(df: DataFrame, order: list, name: str = "position",
                    n_blocks: int | None = None) -> DataFrame:
    """0-based position of every row in the total order ``order`` -- without a
    single-partition window.

    One range shuffle sorts the data into ``n`` contiguous ranges; within a
    range the position is the row's index (``monotonically_increasing_id``
    after ``sortWithinPartitions``); the offset of each range is the count of
    all earlier ranges, from a table of at most ``n`` rows that is broadcast.
    ``order`` must be unique (add an id as the last key) so that re-computation
    after a lost executor yields the same positions.
    """
    n = _n_blocks(df, n_blocks)
    oc = _order_cols(order)
    r = cut_lineage(df.repartitionByRange(n, *oc).sortWithinPartitions(*oc)
                    .withColumn(_BLK, F.spark_partition_id())
                    .withColumn("_tl_mono", F.monotonically_increasing_id()))
    per_block = r.groupBy(_BLK).agg(F.count(F.lit(1)).alias("_tl_n"),
                                    F.min("_tl_mono").alias("_tl_first"))
    # <= n rows: a window over the whole (tiny) block table is fine.
    offsets = per_block.select(
        _BLK, "_tl_first",
        F.coalesce(F.sum("_tl_n").over(Window.orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_tl_off"))
    out = r.join(F.broadcast(offsets), on=_BLK, how="inner") \
           .withColumn(name, (F.col("_tl_off") + F.col("_tl_mono") - F.col("_tl_first")).cast("bigint"))
    return out.drop(_BLK, "_tl_mono", "_tl_first", "_tl_off")


def first_n(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first ``n`` rows in ``order`` (unique), by their global position: no task merges them."""
    return global_position(df, order, "_tl_position_").where(F.col("_tl_position_") < n).drop("_tl_position_")
