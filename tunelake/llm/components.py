"""Connected components of an edge table by alternating star contractions.

Each round hangs every node on its smallest neighbour, from above (large star)
and from below (small star); the number of rounds grows with the logarithm of
the component size, not with its diameter.  Minima are combined before the
shuffle, so a hub costs no more than its edges; nothing is collected or
broadcast.  Rounds are written to the shared folder, which also cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import release, scratch, unsent


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v): root is the component's smallest node.

    Null ends and loops are ignored; repeated edges count once; an empty table
    gives an empty table.
    """
    now = scratch(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
                  .distinct(), "edges")
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = (both.join(unsent(least), "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        below = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(unsent(below), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(below.select("u", F.col("m").alias("v")))
                 .where("u <> v")
                 .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        new = scratch(small, "edges")
        was, state = state, _state(new)
        release(now)
        now = new
        if state == was:
            break
    # Every edge now hangs a node on its root.
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: equal for equal tables."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")), F.sum("v")).first()
    return tuple(row)
