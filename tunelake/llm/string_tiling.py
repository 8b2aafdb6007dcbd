"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items meet on shared seeds, hashes of ``min_tile``
successive words.  For every pair that meets, tiles are laid: the longest
common run of words that uses no marked word on either side is marked, again
and again, until no run of ``min_tile`` words is left.  The share of the
item's words under tiles is the coverage; parts of a passage in another order
are still covered.  A document is contaminated if an item reaches the
threshold.

Seeds are Karp-Rabin hashes over whole texts; runs are compared word by word,
so equal hashes of different words never count.

The benchmark side is small next to the corpus: while it has at most
``BROADCAST_WORDS`` words it goes to every task and the documents are not
shuffled.  Beyond, seeds are joined by a shuffle and only pairs that meet are
tiled.  Both ways give the same rows.

An item is a distinct (item_id, text): ids may repeat with other texts, or be
null, and every text is searched.

Cases: null and empty texts have no words and are clean; items without words
match nothing, items shorter than ``min_tile`` words must be met whole; ties
for the best item go to the smallest id, a null id comes last; repeated rows
are judged one by one; an empty table on either side is fine; extra columns
are ignored.
"""

from __future__ import annotations

import heapq
import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

from tunelake.llm.common import others_packed, scratch, unsent

MIN_TILE = 5
THRESHOLD = 0.6
BROADCAST_WORDS = 2_000_000
WORDS = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def word_hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode()) | 1


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash of every run of ``size`` words."""
    if len(h) < size:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * BASE + h[k:len(h) - size + 1 + k]
    return out


def tile(doc: list[str], item: list[str], seeds: list[tuple[int, int]], min_tile: int) -> list[tuple[int, int, int]]:
    """Tiles (doc position, item position, words), longest first.

    ``seeds``: places where ``min_tile`` words of both sides have one hash.
    """
    runs: list[tuple[int, int, int]] = []
    end: dict[int, int] = {}
    for p, q in sorted(seeds):
        if p < end.get(p - q, -1):
            continue  # inside the last run of this diagonal
        if doc[p:p + min_tile] != item[q:q + min_tile]:
            continue
        n = min_tile
        while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n]:
            n += 1
        # Seeds of the same run start before its last min_tile - 1 words.
        end[p - q] = p + n - min_tile + 1
        runs.append((-n, p, q))
    heapq.heapify(runs)
    in_doc, in_item, tiles = set(), bytearray(len(item)), []
    while runs:
        n, p, q = heapq.heappop(runs)
        n = -n
        free = [not in_item[q + k] and p + k not in in_doc for k in range(n)]
        if all(free):
            tiles.append((p, q, n))
            in_doc.update(range(p, p + n))
            in_item[q:q + n] = b"\1" * n
            continue
        k = 0  # what is left of the run goes back as shorter runs
        while k < n:
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= min_tile:
                    heapq.heappush(runs, (k - e, p + k, q + k))
                k = e
            else:
                k += 1
    return tiles


class Items:
    """Benchmark items with their seeds, by seed length."""

    def __init__(self, rows: list[tuple[int, list[str]]], min_tile: int):
        self.min_tile = min_tile
        self.words = {}
        self.hash_of: dict[str, int] = {}
        self.seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for item, words in sorted(rows):
            if not words or item in self.words:
                continue
            self.words[item] = words
            size = min(min_tile, len(words))
            for w in words:
                if w not in self.hash_of:
                    self.hash_of[w] = word_hash(w)
            h = np.asarray([self.hash_of[w] for w in words], np.uint64)
            at = self.seeds.setdefault(size, {})
            for q, s in enumerate(windows(h, size).tolist()):
                at.setdefault(s, []).append((item, q))
        self.sorted = {n: np.sort(np.fromiter(x, np.uint64, len(x))) for n, x in self.seeds.items()}

    def best(self, text: str | None) -> tuple[int | None, int, float]:
        """(best item, items with a tile, best coverage) of a text."""
        words = words_of(text)
        get = self.hash_of.get
        h = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        met: dict[int, list[tuple[int, int]]] = {}
        for size, known in self.sorted.items():
            hashes = windows(h, size)
            if not len(hashes):
                continue
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for p in np.flatnonzero(known[at] == hashes).tolist():
                for item, q in self.seeds[size][int(hashes[p])]:
                    met.setdefault(item, []).append((p, q))
        best, n = (0.0, None), 0
        for item in sorted(met):
            other = self.words[item]
            tiles = tile(words, other, met[item], min(self.min_tile, len(other)))
            if tiles:
                n += 1
                share = sum(t[2] for t in tiles) / len(other)
                if share > best[0]:
                    best = (share, item)
        return best[1], n, best[0]


FOUND = StructType([StructField("item_id", LongType()), StructField("n_items", IntegerType()),
                    StructField("coverage", DoubleType())])


def _near(docs: DataFrame, rows: list, min_tile: int) -> DataFrame:
    """All items (item_id, words) in every task; rows stay where they are."""
    # Numbered by id, so that the first of equal items has the smallest one.
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    sent = docs.sparkSession.sparkContext.broadcast(rows)
    built: list[Items] = []

    @F.pandas_udf(FOUND)
    def best(text: pd.Series) -> pd.DataFrame:
        if not built:
            built.append(Items([(k, r[1]) for k, r in enumerate(sent.value)], min_tile))
        found = [built[0].best(t) for t in text]
        return pd.DataFrame({"item_id": pd.array([None if f[0] is None else sent.value[f[0]][0] for f in found], dtype="Int64"),
                             "n_items": [f[1] for f in found], "coverage": [f[2] for f in found]})

    return docs.withColumn("_found", best("text"))


def _far(docs: DataFrame, items: DataFrame, min_tile: int) -> DataFrame:
    """Items and documents meet by a shuffle on seed hashes; only pairs that meet are tiled."""
    items = scratch(items.withColumn("item", F.monotonically_increasing_id()), "items")  # one number in all joins

    def item_seeds(batches):
        for b in batches:
            out = []
            for item, t in zip(b["item"], b["text"]):
                words = words_of(t)
                size = min(min_tile, len(words))
                if size:
                    h = np.asarray([word_hash(w) for w in words], np.uint64)
                    out += [(size, s, item) for s in set(windows(h, size).astype(np.int64).tolist())]
            yield pd.DataFrame(out, columns=["size", "seed", "item"])

    seeds = items.select("item", "text").mapInPandas(item_seeds, "size int, seed long, item long")
    sizes = [r["size"] for r in seeds.select("size").distinct().collect()]  # min_tile values at most

    def doc_seeds(batches):
        for b in batches:
            for key, t in zip(b["_key"], b["text"]):
                h = np.asarray([word_hash(w) for w in words_of(t)], np.uint64)
                for size in sizes:
                    got = np.unique(windows(h, size)).astype(np.int64)
                    yield pd.DataFrame({"size": size, "seed": got, "_key": key})

    keyed = docs.withColumn("_key", F.sha2(F.coalesce(F.col("text"), F.lit("")), 256))
    texts = keyed.select("_key", "text").dropDuplicates(["_key"])  # equal texts are tiled once
    pairs = (texts.mapInPandas(doc_seeds, "size int, seed long, _key string")
             .join(unsent(seeds), ["size", "seed"]).select("_key", "item").distinct())

    def tiled(batches):
        for b in batches:
            found = [Items([(i, words_of(x))], min_tile).best(t) for i, x, t in zip(b["item"], b["passage"], b["text"])]
            yield pd.DataFrame({"_key": b["_key"], "item": b["item"], "n": [f[1] for f in found],
                                "share": [f[2] for f in found]})

    met = (pairs.join(unsent(items.select("item", F.col("text").alias("passage"))), "item").join(unsent(texts), "_key")
           .select("_key", "item", "passage", "text").mapInPandas(tiled, "_key string, item long, n int, share double")
           .where("n > 0").join(unsent(items.select("item", "item_id")), "item"))
    best = met.groupBy("_key").agg(F.struct(
        F.min_by("item_id", F.struct(-F.col("share"), F.col("item_id").isNull(), F.col("item_id"))).alias("item_id"),
        F.count("*").cast("int").alias("n_items"), F.max("share").alias("coverage")).alias("_found"))
    return keyed.join(unsent(best), "_key", "left").drop("_key")


def with_tiling(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD,
                broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """``docs`` with _found (item_id, n_items, coverage) and _contaminated."""
    items = benchmark.where(F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    # Letters bound the words from above, so the size is known before anything is collected.
    size = items.agg(F.coalesce(F.sum(F.length("text") + 1), F.lit(0))).first()[0]
    if size <= 2 * broadcast_words:
        found = _near(docs, [(r["item_id"], words_of(r["text"])) for r in items.collect()], min_tile)
    else:
        found = _far(docs, items, min_tile)
    return found.withColumn("_contaminated", F.coalesce(F.col("_found.coverage"), F.lit(0.0)) >= F.lit(threshold))


def tiling(docs: DataFrame, benchmark: DataFrame, min_tile: int = MIN_TILE, threshold: float = THRESHOLD,
           broadcast_words: int = BROADCAST_WORDS) -> DataFrame:
    """(doc_id, item_id, n_items, coverage, contaminated, kept) of every row of ``docs``."""
    found = with_tiling(docs.select("doc_id", "text"), benchmark, min_tile, threshold, broadcast_words)
    return found.select(
        "doc_id", F.col("_found.item_id").alias("item_id"), F.coalesce("_found.n_items", F.lit(0)).alias("n_items"),
        F.coalesce("_found.coverage", F.lit(0.0)).alias("coverage"), F.col("_contaminated").alias("contaminated"),
        (~F.col("_contaminated")).alias("kept"))


@others_packed
def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that no item reaches, with their columns."""
    return with_tiling(docs, benchmark, threshold=threshold).where(~F.col("_contaminated")).select(*docs.columns)
