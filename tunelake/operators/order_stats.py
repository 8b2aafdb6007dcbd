"""Exact order statistics by counting (A2, A8, R1 on continuous values).

A double becomes a 64-bit integer key of the same order.  Each wanted rank of each
group starts with the interval of all keys of its group; a round counts the
keys in ``BINS`` equal parts of each interval (partial counts in the tasks,
then one row for each part), and the part that holds the rank is the next
interval, from its least to its largest key.  A rank is found when both are
equal: after one or two rounds for distinct values, after five in the worst
case.  No row is sorted, ranked or sent through a shuffle.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BINS = 1 << 14
# Groups whose intervals the driver keeps; with more, ranks come from sorted ranges instead.
MAX_GROUPS = 10_000
_NAN_KEY = (1 << 63) - 1


def order_key(x: Column) -> Column:
    """The bits of a double as a long of the same order: -0.0 equals 0.0, NaN is the largest."""
    x = x.cast("double")
    size = F.abs(x)
    guess = F.floor(F.log2(size))
    power = F.pow(F.lit(2.0), guess)
    exponent = F.when(power > size, guess - 1).when(power * 2.0 <= size, guess + 1).otherwise(guess)
    mantissa = size * F.pow(F.lit(2.0), -exponent)  # 1 <= mantissa < 2, exact
    normal = (exponent + 1023) * F.lit(1 << 52) + ((mantissa - 1.0) * float(1 << 52)).cast("long")
    small = (size * math.ldexp(1.0, 537) * math.ldexp(1.0, 537)).cast("long")
    bits = (F.when(size == 0.0, F.lit(0)).when(size < math.ldexp(1.0, -1022), small)
            .when(size == math.inf, F.lit(0x7FF << 52)).otherwise(normal)).cast("long")
    return F.when(F.isnan(x), F.lit(_NAN_KEY)).when(x < 0, -bits).when(x.isNotNull(), bits)


def key_value(key: int) -> float:
    """The double of a key."""
    if key == _NAN_KEY:
        return math.nan
    value = struct.unpack("<d", struct.pack("<q", abs(key)))[0]
    return -value if key < 0 else value


@dataclass
class _Wanted:
    group: int
    rank: int    # 0-based, inside the interval
    low: int
    high: int

    @property
    def shift(self) -> int:
        s = 0
        while (self.high >> s) - (self.low >> s) >= BINS:
            s += 1
        return s


def _local(spark: SparkSession, rows: list[tuple], schema: T.StructType) -> DataFrame:
    """A small table in the plan itself: its size is known, so Spark broadcasts it."""
    fields = to_arrow_schema(schema)
    columns = list(zip(*rows)) if rows else [() for _ in fields]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields), schema)


def _round(keys: DataFrame, group: list[str], names: list[tuple], open_: list[_Wanted]) -> None:
    """Narrow every open interval to the part that holds its rank."""
    spark = keys.sparkSession
    intervals = sorted({(w.group, w.low, w.high, w.shift) for w in open_})
    number = {iv: i for i, iv in enumerate(intervals)}
    table = T.StructType([T.StructField(f"_g{i}", keys.schema[g].dataType) for i, g in enumerate(group)]) \
        .add("_interval", "integer").add("_low", "long").add("_high", "long").add("_shift", "integer")
    table = _local(spark, [(*names[g], number[g, lo, hi, s], lo, hi, s) for g, lo, hi, s in intervals], table)
    wanted = _local(spark, [(i, number[w.group, w.low, w.high, w.shift], w.rank) for i, w in enumerate(open_)],
                    T.StructType().add("_i", "integer").add("_interval", "integer").add("_rank", "long"))
    inside = F.col("_key").between(F.col("_low"), F.col("_high"))
    for i, g in enumerate(group):
        inside = F.col(g).eqNullSafe(F.col(f"_g{i}")) & inside
    part = F.expr("shiftright(_key, _shift) - shiftright(_low, _shift)")
    parts = (keys.join(F.broadcast(table), inside).groupBy("_interval", part.alias("_part"))  # MAX_GROUPS bounds the table
             .agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_least"), F.max("_key").alias("_most")))
    upto = F.sum("_n").over(Window.partitionBy("_interval").orderBy("_part"))  # at most BINS + 1 rows each
    ends = parts.withColumn("_end", upto)
    hit = (ends.join(F.broadcast(wanted), "_interval")
           .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
           .select("_i", (F.col("_rank") - F.col("_end") + F.col("_n")).alias("_rank"), "_least", "_most"))
    for r in hit.collect():  # one row for each wanted rank
        w = open_[r["_i"]]
        w.rank, w.low, w.high = r["_rank"], r["_least"], r["_most"]


def exact_quantiles(df: DataFrame, value: str, qs, group_by: list[str] | None = None,
                    names: list[str] | None = None) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy's default), one row for each group.

    Null values don't count, a null group is a group, NaN is larger than all numbers.
    """
    from tunelake.operators.profile import quantiles_by_rank
    group = group_by or []
    names = names or [f"q{int(round(q * 100))}" for q in qs]
    keys = df.where(F.col(value).isNotNull()).select(*group, order_key(F.col(value)).alias("_key"))
    keys = keys.persist(StorageLevel.MEMORY_AND_DISK)  # read once for each round
    try:
        totals = keys.groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), F.min("_key").alias("_least"),
                                          F.max("_key").alias("_most")).limit(MAX_GROUPS + 1).collect()
        if len(totals) > MAX_GROUPS:
            return quantiles_by_rank(df, value, qs, group, names)
        totals = [t for t in totals if t["_n"]]
        wanted = {}
        for g, t in enumerate(totals):
            for q in qs:
                at = (t["_n"] - 1) * float(q)
                for rank in {math.floor(at), math.ceil(at)}:
                    wanted[g, rank] = _Wanted(g, rank, t["_least"], t["_most"])
        ids = [tuple(t[c] for c in group) for t in totals]
        while open_ := [w for w in wanted.values() if w.low < w.high]:
            _round(keys, group, ids, open_)
    finally:
        keys.unpersist()
    rows = []
    for g, t in enumerate(totals):
        row = list(ids[g])
        for q in qs:
            at = (t["_n"] - 1) * float(q)
            low, high = (key_value(wanted[g, r].low) for r in (math.floor(at), math.ceil(at)))
            row.append(low + (high - low) * (at - math.floor(at)) if high != low else low)
        rows.append(tuple(row))
    schema = df.select(*group).schema
    for name in names:
        schema = schema.add(name, "double")
    return _local(df.sparkSession, rows, schema)
