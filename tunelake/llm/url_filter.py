"""URL filter: host rules first, gradient-boosted trees for the rest.  Native.

Rules decide a URL outright.  The URLs they decide are the labelled training
set of the trees (block = 1); the trees judge every other URL from lexical
features: length, depth, digit ratio, entropy, parameter count and the block
rate of the host's suffix.  Training is histogram boosting written as
DataFrame aggregations: features are cut into at most ``BINS`` bins, equal
binned rows are added up first, so every boosting level is one aggregation of
that small table and the driver only sees (node, feature, bin) sums.

Cases: a null URL or one without ``://`` has empty host and path, no rule and
the trees' verdict; a table without labelled URLs gives ``default`` verdicts;
URLs of any length are read whole; equal URLs get equal verdicts, row by row; an
empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tunelake.llm.common import scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# Production rules of the query.
RULES = (
    UrlRule("net", "/", "block"),
    UrlRule("example.net", "/en/", "allow"),
    UrlRule("example.com", "/de/", "block"),
    UrlRule("org", "/fr/", "allow"),
)

FEATURES = ("length", "host_length", "depth", "digit_ratio", "entropy", "n_params", "labels", "suffix_rate")
BINS, DEPTH, TREES, RATE, RIDGE, SMOOTH = 16, 3, 12, 0.3, 1.0, 20.0
FOLDS = 5


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Add host (A-Z lowered) and path; both empty for null or schemeless URLs."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)")).otherwise(F.lit(""))
    return (df.withColumn("_rest", F.coalesce(rest, F.lit("")))
            .withColumn("host", F.translate(F.regexp_extract("_rest", r"^[^/?#]*", 0), UPPER, LOWER))
            .withColumn("path", F.regexp_extract("_rest", r"^[^/?#]*([^?#]*)", 1))
            .drop("_rest"))


def match_rule(host: Column, path: Column, rules, value) -> Column:
    """CASE over the rules, longest first: ``value(rule)`` of the first that fits."""
    out = None
    for r in sorted(rules, key=lambda r: -len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))) if out is None else out.when(fits, F.lit(value(r)))
    return F.lit(None).cast("string") if out is None else out


def with_features(df: DataFrame, url: str = "url") -> DataFrame:
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    shape = F.concat(F.col("host"), F.col("path"))
    size = F.length(shape)
    letters = F.array_distinct(F.split(shape, ""))
    entropy = F.aggregate(
        F.filter(letters, lambda c: F.length(c) > 0), F.lit(0.0),
        lambda acc, c: acc - ((size - F.length(F.replace(shape, c, F.lit("")))) / size)
        * F.log2((size - F.length(F.replace(shape, c, F.lit("")))) / size))
    return df.withColumns({
        "length": n.cast("double"),
        "host_length": F.length("host").cast("double"),
        "depth": (F.length("path") - F.length(F.translate("path", "/", ""))).cast("double"),
        "digit_ratio": F.when(n > 0, (n - F.length(F.translate(u, "0123456789", ""))) / n).otherwise(0.0),
        "entropy": F.when(size > 0, entropy).otherwise(0.0),
        "n_params": F.size(F.filter(F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&"), lambda p: p != "")).cast("double"),
        "labels": (F.length("host") - F.length(F.translate("host", ".", ""))).cast("double"),
        "suffix": F.regexp_extract("host", r"[^.]*$", 0),
    })


@dataclass
class Tree:
    """splits[(level, node)] = (feature, bin): right if value > bin; leaves by node."""
    splits: dict
    leaves: dict

    def node(self, binned, level: int) -> Column:
        """Number of the node a row reaches after ``level`` splits."""
        at = F.lit(0)
        for k in range(level):
            step = F.lit(0)
            for (lv, node), (f, b) in self.splits.items():
                if lv == k:
                    step = F.when((at == node) & (binned(f) > b), 1).otherwise(step)
            at = at * 2 + step
        return at

    def value(self, binned) -> Column:
        def walk(level, node):
            if (level, node) not in self.splits:
                return F.lit(float(self.leaves.get((level, node), 0.0)))
            f, b = self.splits[(level, node)]
            return F.when(binned(f) > b, walk(level + 1, 2 * node + 1)).otherwise(walk(level + 1, 2 * node))
        return walk(0, 0)


@dataclass
class Model:
    cuts: dict
    base: float
    prior: float
    trees: list

    def margin(self, binned) -> Column:
        out = F.lit(float(self.base))
        for t in self.trees:
            out = out + t.value(binned)
        return out


def _bin(value: Column, cuts: list[float]) -> Column:
    out = F.lit(0)
    for c in cuts:
        out = out + F.when(value > F.lit(float(c)), 1).otherwise(0)
    return out


def fit(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> Model | None:
    """Boost on ``labelled`` (features, label 0/1).  None without rows of both kinds."""
    stats = labelled.agg(
        F.count("*").alias("n"), F.sum("label").alias("pos"),
        *[F.percentile_approx(f, [k / BINS for k in range(1, BINS)], 1000).alias(f) for f in FEATURES]).first()
    n, pos = stats["n"] or 0, stats["pos"] or 0
    if not 0 < pos < n:
        return None
    cuts = {f: sorted(set(stats[f])) for f in FEATURES}
    small = scratch(
        labelled.select("label", *[_bin(F.col(f), cuts[f]).alias(f) for f in FEATURES])
        .groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("label").alias("pos")).coalesce(8), "url-bins")
    base = math.log(pos / (n - pos))
    model = Model(cuts, base, pos / n, [])
    for _ in range(trees):
        tree = Tree({}, {})
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin(F.col)))
        rows = small.withColumn("_p", p).select(
            *FEATURES, (F.col("pos") - F.col("n") * F.col("_p")).alias("_g"),
            (F.col("n") * F.col("_p") * (1 - F.col("_p"))).alias("_h"))
        open_nodes = {0}
        for level in range(depth + 1):
            pairs = ", ".join(f"'{f}', `{f}`" for f in FEATURES)
            sums = (rows.withColumn("_node", tree.node(F.col, level))
                    .select("_node", "_g", "_h", F.expr(f"stack({len(FEATURES)}, {pairs}) as (_f, _b)"))
                    .groupBy("_node", "_f", "_b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect())
            grown = set()
            for node in sorted(open_nodes):
                here = [r for r in sums if r["_node"] == node]
                one = [r for r in here if r["_f"] == FEATURES[0]]
                g, h = sum(r["g"] for r in one), sum(r["h"] for r in one)
                tree.leaves[(level, node)] = rate * g / (h + RIDGE)
                if level == depth:
                    continue
                best = (1e-6, None, None)
                for f in FEATURES:
                    gl = hl = 0.0
                    mine = sorted((r["_b"], r["g"], r["h"]) for r in here if r["_f"] == f)
                    for b, rg, rh in mine[:-1]:
                        gl, hl = gl + rg, hl + rh
                        gain = gl * gl / (hl + RIDGE) + (g - gl) ** 2 / (h - hl + RIDGE) - g * g / (h + RIDGE)
                        if gain > best[0] + 1e-12:
                            best = (gain, f, b)
                if best[1] is not None:
                    tree.splits[(level, node)] = best[1:]
                    grown |= {2 * node, 2 * node + 1}
            if not grown:
                break
            open_nodes = grown
        model.trees.append(tree)
    return model


def url_filter(pages: DataFrame, rules=RULES, url: str = "url", default: str = "allow",
               threshold: float = 0.5, trees: int = TREES) -> DataFrame:
    """``pages`` (page_id, url) with host, path, rule, verdict and the trees' score.

    The suffix block rate is smoothed towards the overall rate with weight
    ``SMOOTH``; it is a joined aggregate, so the number of suffixes is unbounded.
    A row that the trees learn from gets the rate of the other ``FOLDS`` - 1 parts
    of the labelled urls, so it doesn't see its own label.
    """
    df = with_features(with_host_path(pages.select("page_id", F.col(url).alias("url"))))
    host, path = F.col("host"), F.col("path")
    df = df.withColumns({"rule": match_rule(host, path, rules, lambda r: r.name),
                         "_by_rule": match_rule(host, path, rules, lambda r: r.verdict)})
    labelled = df.where(F.col("_by_rule").isNotNull()).withColumn(
        "label", (F.col("_by_rule") == "block").cast("int"))
    rates = labelled.groupBy("suffix").agg(F.count("*").alias("_n"), F.sum("label").alias("_pos"))
    total = rates.agg(F.sum("_n"), F.sum("_pos")).first()
    prior = total[1] / total[0] if total[0] else 0.0

    def smoothed(n, pos):
        return (pos + SMOOTH * prior) / (n + SMOOTH)

    def with_rate(x):
        known = rates.select("suffix", smoothed(F.col("_n"), F.col("_pos")).alias("_rate"))
        return x.join(known, "suffix", "left").withColumn(
            "suffix_rate", F.coalesce(F.col("_rate"), F.lit(float(prior)))).drop("_rate")

    parts = labelled.withColumn("_fold", F.pmod(F.xxhash64(F.coalesce("url", F.lit(""))), F.lit(FOLDS)))
    own = parts.groupBy("suffix", "_fold").agg(F.count("*").alias("_own_n"), F.sum("label").alias("_own_pos"))
    others = own.join(rates, "suffix").select(
        "suffix", "_fold", smoothed(F.col("_n") - F.col("_own_n"), F.col("_pos") - F.col("_own_pos")).alias("suffix_rate"))
    model = fit(parts.join(others, ["suffix", "_fold"]), trees=trees)
    if model is None:
        return df.select("page_id", "host", "path", "rule",
                         F.coalesce("_by_rule", F.lit(default)).alias("verdict"), F.lit(None).cast("double").alias("score"))
    binned = with_rate(df).withColumns({f"_b_{f}": _bin(F.col(f), model.cuts[f]) for f in FEATURES})
    scored = binned.withColumn(
        "score", F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin(lambda f: F.col(f"_b_{f}")))))
    by_trees = F.when(F.col("score") >= threshold, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_by_rule", by_trees).alias("verdict"), "score")
