from pyspark.sql import Window
from pyspark.sql import functions as F

from tunelake.operators.segmented import global_position, previous_value, row_ordinal, running_aggregates
from tunelake.session import cut_lineage


def skewed(spark):
    # key 0 holds about a third of all rows
    return spark.range(0, 3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17).alias("k"),
        F.col("id").alias("o"), ((F.col("id") * 7919) % 101).cast("double").alias("v"))


def test_running_aggregates_equal_plain_windows(spark):
    df = skewed(spark)
    got = running_aggregates(df, ["k"], ["o"], {
        "s": ("sum", F.col("v"), True), "c": ("count", F.lit(1), True),
        "mn": ("min", F.col("v"), False), "mx": ("max", F.col("v"), True)}, n_blocks=5)
    w = Window.partitionBy("k").orderBy("o")
    inc = w.rowsBetween(Window.unboundedPreceding, 0)
    exc = w.rowsBetween(Window.unboundedPreceding, -1)
    ref = df.select("k", "o", F.sum("v").over(inc).alias("s2"), F.count(F.lit(1)).over(inc).alias("c2"),
                    F.min("v").over(exc).alias("mn2"), F.max("v").over(inc).alias("mx2"))
    j = got.join(ref, ["k", "o"])
    assert j.count() == 3000
    bad = j.where("s <> s2 OR c <> c2 OR NOT (mn <=> mn2) OR mx <> mx2").count()
    assert bad == 0


def test_ordinal_lag_and_global_position(spark):
    df = skewed(spark)
    o = row_ordinal(df, ["k"], ["o"], "ord", n_blocks=4)
    ref = df.select("k", "o", F.row_number().over(Window.partitionBy("k").orderBy("o")).alias("ord2"))
    assert o.join(ref, ["k", "o"]).where("ord <> ord2").count() == 0
    lg = previous_value(df, ["k"], ["o"], "v", "prev", n_blocks=4)
    ref2 = df.select("k", "o", F.lag("v").over(Window.partitionBy("k").orderBy("o")).alias("prev2"))
    assert lg.join(ref2, ["k", "o"]).where("NOT (prev <=> prev2)").count() == 0
    gp = global_position(df, ["v", "o"], "pos", n_blocks=6)
    ref3 = df.select("o", (F.row_number().over(Window.orderBy("v", "o")) - 1).alias("pos2"))
    assert gp.join(ref3, "o").where("pos <> pos2").count() == 0


def test_sums_do_not_depend_on_the_cut(spark):
    from tunelake.operators.segmented import running_aggregates
    df = spark.range(600).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"),
                                 (F.rand(3) * F.pow(F.lit(10.0), F.col("id") % 7)).alias("v"))
    df = spark.createDataFrame(df.collect(), df.schema)
    spec = {"s": ("sum", F.col("v"), True)}
    runs = [sorted(map(tuple, running_aggregates(df, ["k"], ["o"], spec, n_blocks=n).collect())) for n in (1, 8, 200)]
    assert runs[0] == runs[1] == runs[2]


def test_ranges_follow_the_bytes(spark, tmpdir_fresh, monkeypatch):
    from tunelake.operators import segmented as G
    spark.range(20000).write.parquet(tmpdir_fresh + "/t")
    df = spark.read.parquet(tmpdir_fresh + "/t")
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert G._n_blocks(df, None) == least and G._n_blocks(df, 3) == 3
    monkeypatch.setattr(G, "BLOCK_BYTES", 1000)
    assert G._n_blocks(df, None) > 40
    assert G._n_blocks(df.crossJoin(df.limit(3)), None) < 1000  # the inputs count, not an estimate of the join


def test_blocks_of_a_checkpoint_follow_its_bytes(spark):
    """Spark takes a join for the product of its sides and keeps that estimate over a checkpoint."""
    import tunelake.operators.segmented as G
    side = spark.range(200_000).withColumn("v", F.rand(1))
    joined = cut_lineage(side.join(side.select("id", F.col("v").alias("w")), "id", "left"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert G._n_blocks(joined, None) == least
    assert G._n_blocks(joined.unionByName(joined), 3) == 3
    got = row_ordinal(joined.withColumn("g", F.col("id") % 2), ["g"], ["id"]).agg(F.sum("ordinal")).first()[0]
    assert got == 2 * sum(range(1, 100_001))
