"""Paired significance tests, comparison tables and their charts' data
(H1-H6, J1-J3, A7-A9)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tunelake.functions.stats import EXACT_SIGNED_RANK_MAX_N, t_pvalue, wilcoxon_pvalue
from tunelake.operators.order_stats import exact_quantiles
from tunelake.operators.profile import histogram
from tunelake.operators.segmented import running_aggregates
from tunelake.session import cut_lineage

NAN, INF = float("nan"), float("inf")


def check_paired(spark_df: DataFrame, base: str = "base", fused: str = "fused") -> int:
    """Single comparison input checks; returns n.  One tiny aggregate row."""
    r = spark_df.agg(F.count_if(F.col(base).isNotNull() & F.col(fused).isNotNull()).alias("both"),
                     F.count_if(F.col(base).isNotNull() != F.col(fused).isNotNull()).alias("one")).first()
    if r["one"]:
        raise ValueError(f"{r['one']} observations have a score on one side only")
    if r["both"] < 2:
        raise ValueError(f"a paired test needs two observations or more, got {r['both']}")
    return int(r["both"])


def paired_summary(paired: DataFrame, group: list[str], base: str = "base", fused: str = "fused") -> DataFrame:
    """Means, delta, t statistic and Cohen's d per group, in one aggregation.
    Only rows with both scores count."""
    d = F.col(fused) - F.col(base)
    g = paired.where(d.isNotNull()).groupBy(*group).agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.avg(base).alias("base_mean"), F.avg(fused).alias("fused_mean"),
        F.avg(d).alias("d_mean"), F.stddev_samp(d).alias("d_sd"),
        F.count_if(d == 0).cast("bigint").alias("n_zero"))
    sd, mean, n = F.col("d_sd"), F.col("d_mean"), F.col("n")
    t = (F.when(n < 2, F.lit(None).cast("double"))
          .when(sd == 0, F.when(mean == 0, F.lit(NAN)).when(mean > 0, F.lit(INF)).otherwise(F.lit(-INF)))
          .otherwise(mean / (sd / F.sqrt(n.cast("double")))))
    status = F.when(n < 2, F.lit("too_few")).otherwise(F.lit("ok"))
    return g.select(*group, "n", "base_mean", "fused_mean",
                    (F.col("fused_mean") - F.col("base_mean")).alias("mean_delta"),
                    t.alias("t_statistic"), (n - 1).cast("double").alias("t_df"),
                    F.when(sd > 0, mean / sd).otherwise(F.lit(0.0)).alias("cohens_d"),
                    "n_zero", status.alias("status"))


def wilcoxon_stats(paired: DataFrame, group: list[str], base: str = "base", fused: str = "fused") -> DataFrame:
    """R+, R-, W = min(R+, R-), the tie term sum(t^3 - t) and n per group.

    Zeros are dropped; average ranks of tied |d| come from counts per distinct
    |d| (a partially aggregated group-by) and a running count over the
    distinct values per group (the skew-safe segmented window), so no group
    is ever sorted in one task.
    """
    d = (F.col(fused) - F.col(base))
    nz = paired.select(*group, d.alias("d")).where((F.col("d") != 0) & F.col("d").isNotNull())
    ties = nz.groupBy(*group, F.abs("d").alias("a")).agg(
        F.count(F.lit(1)).alias("t"), F.count_if(F.col("d") > 0).alias("pos"))
    ranked = running_aggregates(ties, group, ["a"], {"cum": ("sum", F.col("t"), True)})
    avg_rank = F.col("cum") - (F.col("t") - 1) / 2.0
    return ranked.groupBy(*group).agg(
        F.sum("t").cast("bigint").alias("n_nonzero"),
        F.sum(F.col("pos") * avg_rank).alias("r_plus"),
        F.sum((F.col("t") - F.col("pos")) * avg_rank).alias("r_minus"),
        F.sum(F.pow(F.col("t").cast("double"), 3) - F.col("t")).alias("tie_term"),
        F.max(F.col("t") > 1).alias("has_ties"),
        # The ties by increasing value, of the ranks that an exact distribution may need: a bounded list.
        F.transform(F.array_sort(F.collect_list(F.when(F.col("cum") <= EXACT_SIGNED_RANK_MAX_N, F.struct("a", "t")))),
                    lambda x: x["t"]).alias("ties")) \
        .withColumn("w_statistic", F.least("r_plus", "r_minus"))


def significance_report(paired: DataFrame, group: list[str], alpha: float = 0.01,
                        base: str = "base", fused: str = "fused", method: str = "auto") -> DataFrame:
    """One row per comparison: the reference's result fields plus the Wilcoxon
    method used (``method`` as in ``stats.wilcoxon_p``: "exact" also covers ties).  Significant = t-test p < alpha AND mean delta > 0; a NaN p
    is never significant.  All-zero differences give W = 0, p = 1."""
    if not group:  # a single comparison: group on a literal column, dropped at the end
        out = significance_report(paired.withColumn("_all", F.lit(0)), ["_all"], alpha, base, fused, method)
        return out.drop("_all")
    # Both statistics read the pairs; materialize them once (and cut lineage).
    paired = cut_lineage(paired.select(*group, base, fused))
    s = paired_summary(paired, group, base, fused)
    w = wilcoxon_stats(paired, group, base, fused)
    j = s.join(w, on=group, how="left")
    wp = wilcoxon_pvalue(F.coalesce("w_statistic", F.lit(0.0)), F.coalesce("n_nonzero", F.lit(0)),
                         F.col("tie_term"), F.col("n_zero"), F.col("has_ties"), F.col("ties"), method)
    # Arrow turns a NaN returned by a pandas UDF into null: keep NaN natively.
    tp = F.when(F.isnan("t_statistic"), F.lit(NAN)).otherwise(t_pvalue(F.col("t_statistic"), F.col("t_df")))
    j = j.withColumn("t_test_p_value", tp) \
         .withColumn("_w", wp)
    p_ok = F.col("t_test_p_value").isNotNull() & ~F.isnan("t_test_p_value")
    sig = p_ok & (F.col("t_test_p_value") < alpha) & (F.col("mean_delta") > 0)
    return j.select(*group, "n", "status",
                    F.round("base_mean", 6).alias("base_mean"), F.round("fused_mean", 6).alias("fused_mean"),
                    F.round("mean_delta", 6).alias("mean_delta"), F.round("t_statistic", 6).alias("t_statistic"),
                    "t_test_p_value",
                    F.round(F.coalesce("w_statistic", F.lit(0.0)), 6).alias("wilcoxon_statistic"),
                    F.col("_w.p").alias("wilcoxon_p_value"), F.col("_w.method").alias("wilcoxon_method"),
                    F.round("cohens_d", 6).alias("cohens_d"), F.lit(alpha).alias("alpha_threshold"),
                    sig.alias("is_statistically_significant"))


def variant_pairs(long_scores: DataFrame, keys: list[str], variant: str = "variant", score: str = "score",
                  base: str = "base", fused: str = "fused") -> DataFrame:
    """(keys..., base, fused, n_base, n_fused) of a log that holds both variants, unique by keys and
    variant: one aggregation instead of a join of the log with itself."""
    is_base, is_fused = F.col(variant) == base, F.col(variant) == fused
    return long_scores.where(is_base | is_fused).groupBy(*keys).agg(
        F.max(F.when(is_base, F.col(score))).alias("base"), F.max(F.when(is_fused, F.col(score))).alias("fused"),
        F.count_if(is_base).alias("n_base"), F.count_if(is_fused).alias("n_fused"))


def unmatched_variants(pairs: DataFrame, group: list[str]) -> DataFrame:
    """The counts of ``unmatched_pairs`` from ``variant_pairs``."""
    return pairs.groupBy(*group).agg(
        F.sum("n_base").cast("bigint").alias("n_base"), F.sum("n_fused").cast("bigint").alias("n_fused"),
        F.sum(F.when(F.col("n_fused") == 0, F.col("n_base")).otherwise(0)).cast("bigint").alias("unmatched_base"),
        F.sum(F.when(F.col("n_base") == 0, F.col("n_fused")).otherwise(0)).cast("bigint").alias("unmatched_fused"))


def paired_scores(base_scores: DataFrame, fused_scores: DataFrame, keys: list[str],
                  score: str = "score") -> DataFrame:
    """Positional pairing as a real equi-join on (group, sample id)."""
    b = base_scores.select(*keys, F.col(score).alias("base"))
    f = fused_scores.select(*keys, F.col(score).alias("fused"))
    return b.join(f, on=keys, how="inner").withColumn("delta", F.col("fused") - F.col("base"))


def unmatched_pairs(base_scores: DataFrame, fused_scores: DataFrame, keys: list[str], group: list[str],
                    score: str = "score") -> DataFrame:
    """Length-mismatch detection: a full outer join and the unmatched counts."""
    b = base_scores.select(*keys, F.lit(True).alias("_b"))
    f = fused_scores.select(*keys, F.lit(True).alias("_f"))
    j = b.join(f, on=keys, how="full_outer")
    return j.groupBy(*group).agg(
        F.count_if(F.col("_b")).cast("bigint").alias("n_base"),
        F.count_if(F.col("_f")).cast("bigint").alias("n_fused"),
        F.count_if(F.col("_b") & F.col("_f").isNull()).cast("bigint").alias("unmatched_base"),
        F.count_if(F.col("_f") & F.col("_b").isNull()).cast("bigint").alias("unmatched_fused"))


def model_comparison(long_scores: DataFrame, group: list[str], variant: str = "variant",
                     score: str = "score", variants=("base", "fused")) -> DataFrame:
    """Side-by-side aggregates of the two variants (conditional aggregation)."""
    aggs = []
    for v in variants:
        c = F.when(F.col(variant) == v, F.col(score))
        aggs += [F.count(c).cast("bigint").alias(f"{v}_n"), F.avg(c).alias(f"{v}_mean"),
                 F.min(c).alias(f"{v}_min"), F.max(c).alias(f"{v}_max")]
    return long_scores.groupBy(*group).agg(*aggs)


def metric_improvement(paired: DataFrame, group: list[str], base: str = "base", fused: str = "fused") -> DataFrame:
    g = paired.groupBy(*group).agg(F.avg(base).alias("base_mean"), F.avg(fused).alias("fused_mean"))
    delta = F.col("fused_mean") - F.col("base_mean")
    return g.select(*group, "base_mean", "fused_mean", delta.alias("abs_improvement"),
                    F.when(F.col("base_mean") != 0, delta / F.col("base_mean") * 100.0).alias("pct_improvement"))


def delta_histogram(paired: DataFrame, bins: int = 15, base: str = "base", fused: str = "fused") -> DataFrame:
    d = paired.select((F.col(fused) - F.col(base)).alias("delta"))
    return histogram(d, "delta", bins)


def score_boxplot(long_scores: DataFrame, variant: str = "variant", score: str = "score") -> DataFrame:
    """Quartiles (linear), whiskers at the most extreme values within 1.5 IQR of
    the box, and the outlier count, per variant.  Quartiles are exact, by
    counting (``order_stats``); their table, one row per variant, is joined back."""
    q = exact_quantiles(long_scores, score, (0.25, 0.5, 0.75), [variant], ["q1", "median", "q3"])
    q = q.withColumn("iqr", F.col("q3") - F.col("q1"))
    # One row per variant: AQE broadcasts it after measuring; no size is assumed.
    j = long_scores.join(q, on=variant, how="inner")
    lo = F.col("q1") - 1.5 * F.col("iqr")
    hi = F.col("q3") + 1.5 * F.col("iqr")
    inside = (F.col(score) >= lo) & (F.col(score) <= hi)
    return j.groupBy(variant, "q1", "median", "q3", "iqr").agg(
        F.min(F.when(inside, F.col(score))).alias("whisker_lo"),
        F.max(F.when(inside, F.col(score))).alias("whisker_hi"),
        F.count_if(~inside).cast("bigint").alias("n_outliers"))
