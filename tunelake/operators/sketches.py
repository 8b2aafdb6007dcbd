"""Mergeable quantile sketches.

A sketch (KLL, of the DataSketches library inside Spark) is a column: a table
holds one for each group and day, later days are appended, and any coarser
group is answered by merging them without reading the values again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SKETCH_K = 400
# Normalised rank error that a sketch of SKETCH_K stays under with a probability over 0.99.
RANK_ERROR = 0.0133 * 200 / SKETCH_K * 1.5


def build_sketches(df: DataFrame, value: str, group_by: list[str], k: int = SKETCH_K) -> DataFrame:
    """(group..., n, sketch) of an integer column; null values don't count."""
    return df.where(F.col(value).isNotNull()).groupBy(*group_by).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_bigint(F.col(value).cast("long"), k).alias("sketch"))


def merge_sketches(sketches: DataFrame, group_by: list[str], k: int = SKETCH_K) -> DataFrame:
    """The same table for coarser groups."""
    return sketches.groupBy(*group_by).agg(F.sum("n").alias("n"), F.kll_merge_agg_bigint("sketch", k).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, qs, group_by: list[str]) -> DataFrame:
    """(group..., n, q, estimate)."""
    each = [F.struct(F.lit(float(q)).alias("q"), F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(q))).alias("estimate"))
            for q in qs]
    return sketches.select(*group_by, "n", F.explode(F.array(*each)).alias("e")).select(*group_by, "n", "e.q", "e.estimate")


def rank_errors(estimates: DataFrame, df: DataFrame, value: str, group_by: list[str]) -> DataFrame:
    """``estimates`` with their exact ranks (share of the values below, and up to, the estimate) and the
    ``rank_error``: how far q lies outside of them.  One aggregation over the values."""
    rows = df.where(F.col(value).isNotNull()).select(*group_by, F.col(value).alias("_v"))
    wide = estimates.groupBy(*group_by).agg(F.collect_list(F.struct("q", "estimate")).alias("_e"))
    seen = (rows.join(wide, group_by).select(*group_by, "_v", F.explode("_e").alias("e"))
            .groupBy(*group_by, "e.q", "e.estimate").agg(
                F.count(F.lit(1)).alias("_n"), F.count_if(F.col("_v") < F.col("e.estimate")).alias("_below"),
                F.count_if(F.col("_v") <= F.col("e.estimate")).alias("_upto")))
    low, high = F.col("_below") / F.col("_n"), F.col("_upto") / F.col("_n")
    return seen.select(*group_by, F.col("_n").alias("n"), "q", "estimate", low.alias("rank_below"), high.alias("rank_upto"),
                       F.greatest(low - F.col("q"), F.col("q") - high, F.lit(0.0)).alias("rank_error"))
