"""Generation metrics: LCS, ROUGE-L/1/2, BLEU, fallback aggregate."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.functions.lcs import lcs_length
from tunelake.functions.overlap import clipped_overlaps
from tunelake.functions.text import bleu_tokens, whitespace_tokens, word_tokens


def f1(overlap: Column, pred_n: Column, ref_n: Column) -> Column:
    """2pr/(p+r) with p = overlap/pred_n, r = overlap/ref_n; 0 when undefined."""
    p = F.try_divide(overlap.cast("double"), pred_n.cast("double"))
    r = F.try_divide(overlap.cast("double"), ref_n.cast("double"))
    return F.when((pred_n > 0) & (ref_n > 0) & (overlap > 0), (2.0 * p * r) / (p + r)).otherwise(F.lit(0.0))


def with_rouge_l(df: DataFrame, prediction: str = "prediction", reference: str = "reference",
                 tokens_fn=whitespace_tokens, prefix: str = "") -> DataFrame:
    """Adds ``lcs`` and ``rouge_l`` (F1 over whitespace tokens, case-sensitive).

    The LCS runs once per row in an Arrow UDF; everything else is native.
    """
    pt, rt = tokens_fn(prediction), tokens_fn(reference)
    out = df.withColumn(f"{prefix}pred_len", F.size(pt).cast("bigint")) \
            .withColumn(f"{prefix}ref_len", F.size(rt).cast("bigint")) \
            .withColumn(f"{prefix}lcs", lcs_length(pt, rt))
    return out.withColumn(f"{prefix}rouge_l", f1(F.col(f"{prefix}lcs"), F.col(f"{prefix}pred_len"),
                                                 F.col(f"{prefix}ref_len")))


def sample_score(rouge: Column) -> Column:
    """Per-sample score vector entry: ROUGE-L x 100 at 4 decimals."""
    return F.round(rouge * 100.0, 4)


def generation_metrics_fallback(scored: DataFrame, prediction: str = "prediction",
                                reference: str = "reference", rouge: str = "rouge_l") -> DataFrame:
    """The metrics dict of the dependency-free path: mean ROUGE-L x 100 under
    rouge1, rouge2 and rougeL, bleu 0.0.  No rows, or a prediction without a
    reference (or the reverse), gives all zeros."""
    row = scored.agg(F.count(F.lit(1)).alias("_n"),
                     F.count_if(F.col(prediction).isNull() | F.col(reference).isNull()).alias("_bad"),
                     F.avg(rouge).alias("_m"))
    ok = (F.col("_n") > 0) & (F.col("_bad") == 0)
    v = F.when(ok, F.round(F.col("_m") * 100.0, 4)).otherwise(F.lit(0.0))
    return row.select(v.alias("rouge1"), v.alias("rouge2"), v.alias("rougeL"), F.lit(0.0).alias("bleu"))


def ngram_overlaps(df: DataFrame, id_col: str, pred_tokens: Column, ref_tokens: Column,
                   orders=(1, 2), keep: tuple = ()) -> DataFrame:
    """Per row and order n: clipped n-gram overlap and both n-gram counts.

    All is counted inside the row, so nothing is shuffled and rows that repeat an id stay apart.
    ``keep``: other columns that stay.
    """
    tokens = df.select(id_col, *keep, pred_tokens.alias("_pt"), ref_tokens.alias("_rt"))
    out = tokens.select(id_col, *keep, F.size("_pt").cast("bigint").alias("pred_len"), F.size("_rt").cast("bigint").alias("ref_len"),
                        clipped_overlaps(F.col("_pt"), F.col("_rt"), orders).alias("_overlaps"))
    out = out.select(id_col, *keep, "pred_len", "ref_len", *[F.col("_overlaps")[i].alias(f"overlap_{n}") for i, n in enumerate(orders)])
    for n in orders:
        out = out.withColumn(f"pred_{n}grams", F.greatest(F.col("pred_len") - (n - 1), F.lit(0)).cast("bigint")) \
                 .withColumn(f"ref_{n}grams", F.greatest(F.col("ref_len") - (n - 1), F.lit(0)).cast("bigint"))
    return out


def rouge_n(df: DataFrame, id_col: str, prediction: str = "prediction", reference: str = "reference",
            orders=(1, 2), keep: tuple = ()) -> DataFrame:
    """ROUGE-N F1 per row with the ROUGE library tokenizer (lower-cased
    alphanumeric tokens, no stemming)."""
    o = ngram_overlaps(df, id_col, word_tokens(prediction), word_tokens(reference), orders, keep)
    for n in orders:
        p = F.col(f"overlap_{n}") / F.greatest(F.col(f"pred_{n}grams"), F.lit(1))
        r = F.col(f"overlap_{n}") / F.greatest(F.col(f"ref_{n}grams"), F.lit(1))
        o = o.withColumn(f"rouge{n}", F.when(p + r > 0, 2.0 * p * r / (p + r)).otherwise(F.lit(0.0)))
    return o


def rouge_l_lib(df: DataFrame, prediction: str = "prediction", reference: str = "reference") -> DataFrame:
    """ROUGE-L of the library mode: LCS F1 over lower-cased alphanumeric tokens."""
    return with_rouge_l(df, prediction, reference, tokens_fn=word_tokens, prefix="lib_")


def bleu_corpus(df: DataFrame, id_col: str, prediction: str = "prediction",
                reference: str = "reference", max_order: int = 4) -> DataFrame:
    """Corpus BLEU (Papineni et al. 2002) with one reference per prediction,
    "13a" tokens, no smoothing: clipped n-gram matches and possible matches are
    summed over the corpus per order; any zero precision gives 0; brevity
    penalty exp(1 - r/c) when c <= r."""
    orders = tuple(range(1, max_order + 1))
    o = ngram_overlaps(df, id_col, bleu_tokens(prediction), bleu_tokens(reference), orders)
    tot = o.agg(F.sum("pred_len").cast("bigint").alias("translation_length"),
                F.sum("ref_len").cast("bigint").alias("reference_length"),
                *[F.sum(f"overlap_{n}").cast("bigint").alias(f"matches_{n}") for n in orders],
                *[F.sum(f"pred_{n}grams").cast("bigint").alias(f"possible_{n}") for n in orders])
    prec = [F.when(F.col(f"possible_{n}") > 0, F.col(f"matches_{n}") / F.col(f"possible_{n}"))
            .otherwise(F.lit(0.0)) for n in orders]
    tot = tot.select("*", *[p.alias(f"precision_{n}") for p, n in zip(prec, orders)])
    all_pos = F.least(*[F.col(f"precision_{n}") for n in orders]) > 0
    geo = F.when(all_pos, F.exp(sum(F.log(F.col(f"precision_{n}")) for n in orders) / F.lit(float(max_order)))) \
           .otherwise(F.lit(0.0))
    ratio = F.try_divide(F.col("translation_length").cast("double"), F.col("reference_length").cast("double"))
    bp = F.when(ratio > 1.0, F.lit(1.0)).otherwise(F.exp(1.0 - F.try_divide(F.lit(1.0), ratio)))
    return tot.withColumn("ratio", ratio).withColumn("brevity_penalty", F.coalesce(bp, F.lit(0.0))) \
              .withColumn("bleu", geo * F.col("brevity_penalty"))


# Poisson(1): P(weight <= k), in 2^32 parts.
_POISSON = [int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2 ** 32) for k in range(9)]


def poisson_weight(hash32: Column) -> Column:
    """Weight of a row in one replicate, from 32 hash bits."""
    w = F.lit(0)
    for bound in _POISSON:
        w = w + (hash32 >= bound).cast("int")
    return w


def bootstrap_interval(scores: DataFrame, id_col: str, metrics: list[str], replicates: int = 200,
                       seed: int = 42, level: float = 0.95) -> DataFrame:
    """(metric, low, mid, high): bootstrap interval of each metric's mean.

    A row counts Poisson(1) times in each replicate; the counts come from a hash
    of seed, id and replicate, so the result does not depend on how the rows are
    spread.  All replicates are summed in one aggregation: a row is four
    replicates to a hash, and a task sends one row for each replicate.
    """
    blocks = -(-replicates // 4)
    hashed = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"), F.lit(":"), F.col("_block").cast("string")))
    bits = [F.conv(F.substring(F.col("_hash"), 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]
    values = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics])
    rows = scores.select(id_col, values.alias("_values"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block"))
    weighted = rows.withColumn("_hash", hashed).select(
        "_values", F.explode(F.array(*[F.struct((F.col("_block") * 4 + i).alias("r"), poisson_weight(b).alias("w"))
                                       for i, b in enumerate(bits)])).alias("p")) \
        .where((F.col("p.w") > 0) & (F.col("p.r") < replicates)).select(
            F.col("p.r").alias("r"), F.col("p.w").alias("w"), F.explode("_values").alias("m"))
    means = weighted.where(F.col("m.v").isNotNull()).groupBy("m.metric", "r").agg(
        (F.sum(F.col("w") * F.col("m.v")) / F.sum("w")).alias("mean"))
    tail = (1.0 - level) / 2.0
    ends = means.groupBy("metric").agg(F.percentile("mean", F.array(F.lit(tail), F.lit(0.5), F.lit(1.0 - tail))).alias("p"))
    return ends.select("metric", F.col("p")[0].alias("low"), F.col("p")[1].alias("mid"), F.col("p")[2].alias("high"))
