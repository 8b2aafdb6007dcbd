"""Dataset profiling: null counts, length statistics, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tunelake.functions.text import whitespace_tokens

# The reported quantiles and the two recommended cutoffs.
QUANTILES = (0.5, 0.9, 0.95, 0.99)
CUTOFF_SHORT, CUTOFF_LONG = 2048, 4096
STAT_FIELDS = ("p50", "p90", "p95", "p99", "max_len", "min_len", "mean", "std_dev")


def null_profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(feature, null_count, status) for every column, from a single scan."""
    cols = columns or df.columns
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    long = wide.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("bigint").alias("null_count"))
        for c in cols])).alias("r")).select("r.*")
    return long.withColumn("status", null_status(F.col("null_count")))


def null_status(n: Column) -> Column:
    return F.when(n == 0, F.lit("PASS")).otherwise(F.format_string("WARNING (%d nulls)", n))


def length_stats(x: Column, approx: bool = False, accuracy: int = 10000) -> Column:
    """One struct of p50/p90/p95/p99 (linear interpolation), max, min, mean and
    population std.  ``percentile`` keeps one counter per distinct value,
    which is small for integer lengths; ``approx=True`` switches to the
    bounded-memory sketch for high-cardinality inputs."""
    qs = F.array(*[F.lit(q) for q in QUANTILES])
    p = F.percentile_approx(x, qs, accuracy).cast("array<double>") if approx \
        else F.percentile(x, qs)
    return F.struct(p[0].alias("p50"), p[1].alias("p90"), p[2].alias("p95"), p[3].alias("p99"),
                    F.max(x).cast("bigint").alias("max_len"), F.min(x).cast("bigint").alias("min_len"),
                    F.avg(x).alias("mean"), F.stddev_pop(x).alias("std_dev"))


def with_token_lengths(df: DataFrame, prompt: str = "prompt", response: str = "response",
                       tokens_fn=whitespace_tokens) -> DataFrame:
    """Adds prompt_tokens, response_tokens and their sum total_tokens (bigint)."""
    return df.withColumn("prompt_tokens", F.size(tokens_fn(prompt)).cast("bigint")) \
             .withColumn("response_tokens", F.size(tokens_fn(response)).cast("bigint")) \
             .withColumn("total_tokens", F.col("prompt_tokens") + F.col("response_tokens"))


def recommended_length(p99: Column) -> Column:
    """2048 when the total-length p99 fits, else 4096 (the two values used)."""
    return F.when(p99 <= CUTOFF_SHORT, F.lit(CUTOFF_SHORT)).otherwise(F.lit(CUTOFF_LONG)).cast("bigint")


def length_quantiles(lengths: DataFrame, measures=("prompt_tokens", "response_tokens", "total_tokens"),
                     group_by: list[str] | None = None, approx: bool = False) -> DataFrame:
    """Long table (group..., measure, p50, ..., std_dev) from one aggregation."""
    g = group_by or []
    agg = lengths.groupBy(*g).agg(*[length_stats(F.col(m), approx).alias(m) for m in measures])
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("s"))
                               for m in measures])).alias("r")
    return agg.select(*g, rows).select(*g, "r.measure", *[F.col(f"r.s.{f}").alias(f) for f in STAT_FIELDS])


def eda_summary(pairs_raw: DataFrame, dataset_name: str, prompt: str = "prompt",
                response: str = "response", tokens_fn=whitespace_tokens,
                approx: bool = False) -> DataFrame:
    """The whole profile as ONE row, from ONE scan of the input.

    total_samples counts every row; null counts are per column; the length
    statistics use only rows where both sides are non-null (drop_nulls), which
    is expressed with FILTER-style conditional inputs instead of a second scan.
    """
    ok = F.col(prompt).isNotNull() & F.col(response).isNotNull()
    pl = F.when(ok, F.size(tokens_fn(prompt)))
    rl = F.when(ok, F.size(tokens_fn(response)))
    cols = pairs_raw.columns
    base = pairs_raw.select(*cols, pl.alias("_pl"), rl.alias("_rl")) \
                    .withColumn("_tl", F.col("_pl") + F.col("_rl"))
    row = base.agg(
        F.count(F.lit(1)).alias("total_samples"),
        *[F.count_if(F.col(c).isNull()).alias(f"_null_{c}") for c in cols],
        length_stats(F.col("_pl"), approx).alias("prompt_length_quantiles"),
        length_stats(F.col("_rl"), approx).alias("response_length_quantiles"),
        length_stats(F.col("_tl"), approx).alias("total_sequence_quantiles"))
    return row.select(
        F.lit(dataset_name).alias("dataset_name"),
        F.col("total_samples").cast("bigint").alias("total_samples"),
        F.map_from_arrays(F.array(*[F.lit(c) for c in cols]),
                          F.array(*[F.col(f"_null_{c}").cast("bigint") for c in cols]))
         .alias("missing_value_counts"),
        "prompt_length_quantiles", "response_length_quantiles", "total_sequence_quantiles",
        recommended_length(F.col("total_sequence_quantiles.p99")).alias("recommended_max_seq_length"))


def flatten_summary(summary: DataFrame, columns: list[str] = ("prompt", "response")) -> DataFrame:
    """Flat, comparable form of ``eda_summary`` (one column per number)."""
    out = [F.col("dataset_name"), F.col("total_samples")]
    out += [F.col("missing_value_counts")[c].alias(f"null_{c}") for c in columns]
    for s, short in (("prompt_length_quantiles", "prompt"), ("response_length_quantiles", "response"),
                     ("total_sequence_quantiles", "total")):
        out += [F.col(f"{s}.{f}").alias(f"{short}_{f}") for f in STAT_FIELDS]
    out.append(F.col("recommended_max_seq_length"))
    return summary.select(*out)


def cutoff_coverage(lengths: DataFrame, total: str = "total_tokens", cutoff: int | None = None) -> DataFrame:
    """Share of sequences whose total length fits the cutoff.

    With ``cutoff=None`` the recommended length of the same data is used;
    both come from one aggregation (the p99 and the counts per length are
    computed together, then combined on the one-row result).
    """
    if cutoff is not None:
        return lengths.agg(F.lit(cutoff).cast("bigint").alias("cutoff"),
                           F.count(F.lit(1)).alias("n"),
                           F.avg((F.col(total) <= cutoff).cast("double")).alias("coverage"))
    # Fits for both possible cutoffs are counted in the same pass.
    row = lengths.agg(F.percentile(F.col(total), F.lit(0.99)).alias("p99"),
                      F.count(F.lit(1)).alias("n"),
                      F.count_if(F.col(total) <= CUTOFF_SHORT).alias("fit_short"),
                      F.count_if(F.col(total) <= CUTOFF_LONG).alias("fit_long"))
    cut = recommended_length(F.col("p99"))
    return row.select(cut.alias("cutoff"), F.col("n"),
                      F.try_divide(F.when(cut == CUTOFF_SHORT, F.col("fit_short")).otherwise(F.col("fit_long"))
                                   .cast("double"), F.col("n").cast("double")).alias("coverage"))


def histogram(df: DataFrame, col: str, bins: int, group_by: list[str] | None = None) -> DataFrame:
    """Equal-width histogram with numpy's rules (last bin closed, lo == hi
    widened by 0.5 on each side), one row per bin including empty bins.

    Whole values are first reduced to (group, value, count) with a partially
    aggregated group-by -- for lengths that table is tiny whatever the row
    count -- and that table is checkpointed, so the input is scanned once.
    Fractions, which hardly repeat, are not: the input is scanned once for the
    bounds and once for the bins, and a task sends one row for each bin.
    Bounds are one row per group: without groups that single row is read on
    the driver and becomes two literals; with groups it is joined back (AQE
    turns the join into a broadcast when the measured side is small).
    """
    from tunelake.session import cut_lineage
    g = group_by or []
    # The reduced table is read twice (bounds, then bins): write it once so the
    # input -- and any tokenization feeding ``col`` -- is computed only once.
    rows = df.where(F.col(col).isNotNull()).select(*g, F.col(col).cast("double").alias("v"))
    if isinstance(df.schema[col].dataType, (T.DoubleType, T.FloatType)):
        vc = rows.withColumn("c", F.lit(1))
    else:
        vc = cut_lineage(rows.groupBy(*g, "v").agg(F.count(F.lit(1)).alias("c")))
    b = vc.groupBy(*g).agg(F.min("v").alias("lo0"), F.max("v").alias("hi0"))
    b = b.select(*g, F.when(F.col("lo0") == F.col("hi0"), F.col("lo0") - 0.5).otherwise(F.col("lo0")).alias("lo"),
                 F.when(F.col("lo0") == F.col("hi0"), F.col("hi0") + 0.5).otherwise(F.col("hi0")).alias("hi"))
    if g:
        vcb = vc.join(b, on=g, how="inner")
        bounds = b
    else:
        row = b.first()  # one row: the global bounds
        if row is None or row["lo"] is None:
            return df.sparkSession.createDataFrame(
                [], "bin bigint, bin_lo double, bin_hi double, count bigint")
        vcb = vc.withColumn("lo", F.lit(row["lo"])).withColumn("hi", F.lit(row["hi"]))
        bounds = df.sparkSession.range(1).select(F.lit(row["lo"]).alias("lo"), F.lit(row["hi"]).alias("hi"))
    idx = F.least(F.floor((F.col("v") - F.col("lo")) * F.lit(float(bins)) / (F.col("hi") - F.col("lo"))),
                  F.lit(bins - 1)).cast("bigint")
    counted = vcb.groupBy(*g, idx.alias("bin")).agg(F.sum("c").cast("bigint").alias("count"))
    all_bins = bounds.select(*g, "lo", "hi",
                             F.explode(F.sequence(F.lit(0), F.lit(bins - 1)).cast("array<bigint>")).alias("bin"))
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    out = all_bins.join(counted, on=[*g, "bin"], how="left")
    return out.select(*g, "bin",
                      (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                      F.when(F.col("bin") == bins - 1, F.col("hi"))
                       .otherwise(F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                      F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"))


def quantiles_by_rank(df: DataFrame, value: str, qs, group_by: list[str] | None = None,
                      names: list[str] | None = None) -> DataFrame:
    """Exact linear-interpolation quantiles (numpy's default) from ranks, for very many groups
    (``order_stats.exact_quantiles`` counts instead).

    ``percentile`` keeps one counter per distinct value and merges them in one
    reducer per group: fine for integer lengths, unbounded for continuous
    values of a hot group.  Here each value gets its 1-based rank inside its
    group from the skew-safe segmented ordinal; the group sizes come from a
    partially aggregated count; only the <= 2 rows per quantile that sit at
    floor/ceil of (n - 1) * q are kept and interpolated.
    """
    from tunelake.operators.segmented import row_ordinal
    g = group_by or []
    names = names or [f"q{int(round(q * 100))}" for q in qs]
    vals = df.select(*g, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    ranked = row_ordinal(vals, g, ["_v"], "_rk")
    if g:
        counts = ranked.groupBy(*g).agg(F.count(F.lit(1)).alias("_n"))
        j = ranked.join(counts, on=g, how="inner")
    else:  # one global count: a scalar read from a one-row aggregate
        j = ranked.withColumn("_n", F.lit(ranked.count()).cast("bigint"))
    key = g
    pos = [(F.col("_n") - 1) * F.lit(float(q)) for q in qs]
    lo = [F.floor(p) + 1 for p in pos]
    hi = [F.ceil(p) + 1 for p in pos]
    keep = None
    for a, b in zip(lo, hi):
        c = (F.col("_rk") == a) | (F.col("_rk") == b)
        keep = c if keep is None else keep | c
    picked = j.where(keep)
    aggs = [F.max("_n").alias("_n")]
    for i, (a, b) in enumerate(zip(lo, hi)):
        aggs += [F.max(F.when(F.col("_rk") == a, F.col("_v"))).alias(f"_lo{i}"),
                 F.max(F.when(F.col("_rk") == b, F.col("_v"))).alias(f"_hi{i}")]
    agg = picked.groupBy(*key).agg(*aggs)
    out = [F.col(k) for k in g]
    for i, (q, name) in enumerate(zip(qs, names)):
        p = (F.col("_n") - 1) * F.lit(float(q))
        frac = p - F.floor(p)
        out.append((F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac).alias(name))
    return agg.select(*out)
