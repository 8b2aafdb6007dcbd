"""Near-duplicates by MinHash with tensored banding.

Two collections of ``SUBKEYS`` small hash collisions are computed from each
set of word shingles, ``EACH`` MinHash values to a collision; every pair of one
from each collection is a table key.  ``SUBKEYS ** 2`` tables are served by
``2 * SUBKEYS * EACH`` MinHash values instead of ``SUBKEYS ** 2 * 2 * EACH``:
about the square root.  A pair of similarity s meets with probability
``(1 - (1 - s ** EACH) ** SUBKEYS) ** 2``: 0.9999 at s = 0.8.  A table key can
only be shared where both its halves are, so halves that one class alone has
are dropped before the pairs are formed: most classes never reach a table.

Work is done once for each distinct shingle set (a class).  In a table, every
class is compared with the smallest and the largest class of its bucket, so a
bucket of n costs 2n candidates, not n * n.  Classes of buckets that still hold
several components after that go through an exact prefix filter: two sets of
similarity s share one of their rarest ``(1 - s) * size + 1`` shingles, and
only such pairs of different components are compared.  So no link of a bucket
is lost, and a passage that thousands of texts share pairs none of them.
Candidates are confirmed on full sets (64-bit shingle hashes).

Cases: null and empty texts have no shingles and are linked with nothing; with
fewer words than a shingle the whole sequence is the one element; copies share
a class; rows with the same doc_id are kept as they are; null ids form classes
but are never a component's id while another member has one; an empty table
gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from tunelake.llm.common import give_back, others_packed, release, scratch, unsent
from tunelake.llm.components import components

SUBKEYS, EACH = 20, 4
BITS = 1 << 23
CACHE_WORDS = 500_000
BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return x ^ (x >> np.uint64(33))


class Shingler:
    def __init__(self, size: int):
        self.size, self.cache = size, {}

    def __call__(self, text: str) -> np.ndarray:
        """Sorted distinct shingle hashes of a text."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        cache = self.cache
        new = set(words).difference(cache)
        if new:
            if len(cache) > CACHE_WORDS:
                cache.clear()
                new = set(words)
            for w in new:
                cache[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = _mix(out * BASE + h[k:len(h) - size + 1 + k])
        return np.unique(out)


def _multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(20240229).integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def subkeys(sets: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The 2 * SUBKEYS hash collisions of a set, EACH MinHash values to one."""
    least = np.full(len(a), ~np.uint64(0))
    for at in range(0, len(sets), 4096):  # long texts in pieces: memory stays flat
        least = np.minimum(least, _mix(sets[at:at + 4096, None] * a[None, :]).min(0))
    out = np.zeros(len(a) // EACH, np.uint64)
    for k in range(EACH):
        out = _mix(out * BASE + least[k::EACH])
    return out.astype(np.int64)


SIGNATURE = StructType([StructField("n_shingles", LongType()), StructField("digest", BinaryType()),
                        StructField("a", ArrayType(LongType())), StructField("b", ArrayType(LongType()))])


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """The columns of ``docs`` but text, with n_shingles, digest, a, b; digest names the shingle set."""
    @F.pandas_udf(SIGNATURE)
    def signed(texts: pd.Series) -> pd.DataFrame:
        shingles, mult, out = Shingler(shingle), _multipliers(2 * SUBKEYS * EACH), []
        for t in texts:
            s = shingles(t)
            if len(s):
                k = subkeys(s, mult)
                out.append((len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), k[:SUBKEYS], k[SUBKEYS:]))
            else:
                out.append((0, None, None, None))
        return pd.DataFrame(out, columns=SIGNATURE.names).astype({"digest": object, "a": object, "b": object})

    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, signed(F.coalesce("text", F.lit(""))).alias("s")).select(*rest, "s.*")


def _slot(column: str):
    return F.xxhash64(column).bitwiseAND(BITS - 1)


def _sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cls, items) of the classes in ``wanted`` (cls, doc_id, digest).

    A bitmap of fixed size, filled from ``wanted``, keeps most other rows from
    being shingled again; the join on the digest decides.
    """
    rows = (wanted.select(_slot("doc_id").alias("s")).groupBy(F.shiftright("s", 5).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 31 as int))")).alias("m")).collect())
    bitmap = np.zeros(BITS // 32, np.uint32)
    for r in rows:
        bitmap[r["w"]] = r["m"]
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        shingles = Shingler(shingle)
        for b in batches:
            s = b["s"].to_numpy()
            keep = (sent.value[s >> 5] >> (s & 31).astype(np.uint32)) & 1 == 1
            sets = [shingles(t) for t in b["text"][keep]]
            # Without a wanted row in the batch the columns would be of floats.
            yield pd.DataFrame({"digest": [hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in sets],
                                "items": [x.astype(np.int64) for x in sets]}, dtype=object)
        give_back()

    found = (docs.select(_slot("doc_id").alias("s"), F.coalesce("text", F.lit("")).alias("text"))
             .mapInPandas(run, "digest binary, items array<long>"))
    return found.join(unsent(wanted.select("cls", "digest")), "digest").dropDuplicates(["cls"]).select("cls", "items")


def _confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (u, v) with den * intersection >= num * union."""
    both = (pairs.join(unsent(sets.select(F.col("cls").alias("u"), F.col("items").alias("x"))), "u")
            .join(unsent(sets.select(F.col("cls").alias("v"), F.col("items").alias("y"))), "v")
            .where(den * F.least(F.size("x"), F.size("y")) >= num * F.greatest(F.size("x"), F.size("y"))))
    common = F.size(F.array_intersect("x", "y"))
    return both.where(den * common >= num * (F.size("x") + F.size("y") - common)).select("u", "v")


def _prefix_pairs(sets: DataFrame, roots: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that share one of their rarest shingles."""
    items = sets.select("cls", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # A shingle that one class alone has joins nothing, but it counts in the order.
    known = items.join(unsent(often), "item").groupBy("cls", "n").agg(
        F.sort_array(F.collect_list(F.struct("df", "item"))).alias("few"))
    alone = F.col("n") - F.size("few")
    last = F.col("n") - F.ceil(F.lit(num) * F.col("n") / F.lit(den))  # last place of the prefix
    first = (known.select("cls", "n", alone.alias("alone"), F.slice(
                "few", F.lit(1), F.greatest(last + 1 - alone, F.lit(0)).cast("int")).alias("few"))
             .select("cls", "n", "alone", F.posexplode("few").alias("k", "s"))
             .select("cls", F.col("s.item").alias("item"), F.col("n").cast("long").alias("n"),
                     (F.col("n") - F.col("alone") - F.col("k")).cast("long").alias("rest"))
             .join(unsent(roots), F.col("cls") == F.col("node"), "left")
             .select("cls", "item", "n", "rest", F.coalesce("root", "cls").alias("root")))

    def side(x: str) -> DataFrame:
        return first.select("item", *[F.col(c).alias(c + x) for c in ("cls", "n", "rest", "root")])

    # From their first common shingle on, two sets can share no more than the shorter rest.
    enough = (num + den) * F.least("restu", "restv") >= num * (F.col("nu") + F.col("nv"))
    return (side("u").join(unsent(side("v")), "item").where((F.col("clsu") < F.col("clsv")) & (
                F.col("rootu") != F.col("rootv")) & enough)
            .select(F.col("clsu").alias("u"), F.col("clsv").alias("v")).distinct())


def _candidates(a, b) -> DataFrame:
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


def links(docs: DataFrame, classes: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """(node, root) over the classes that are linked with another one."""
    def shared(half: str, i: str, x: str) -> DataFrame:
        """(cls, number, value) of the half keys that two classes or more have."""
        rows = classes.select("cls", F.posexplode(half).alias(i, x))
        many = rows.groupBy(i, x).agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
        return rows.join(unsent(many.select(i, x)), [i, x])

    keys = scratch(shared("a", "i", "x").join(unsent(shared("b", "j", "y")), "cls").select(
        F.xxhash64("i", "j", "x", "y").alias("key"), "cls"), "keys")
    # Ends of a bucket are combined before the shuffle, so a hot key is one row for each task.
    ends = keys.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo <> hi")
    rows = scratch(keys.join(unsent(ends), "key").select("key", "cls", "lo", "hi"), "buckets")
    near = (rows.where("cls <> lo").select(*_candidates(F.col("cls"), F.col("lo")))
            .unionByName(rows.where("cls <> hi").select(*_candidates(F.col("cls"), F.col("hi")))).distinct())
    near = scratch(near, "near")
    wanted = near.select(F.col("u").alias("cls")).unionByName(near.select(F.col("v").alias("cls"))).distinct()
    sets = scratch(_sets(docs, classes.join(unsent(wanted), "cls"), shingle), "sets")
    good = scratch(_confirm(near, sets, num, den), "links")
    roots = components(good)
    # Classes of buckets that hold several components yet.
    named = rows.join(unsent(roots), rows["cls"] == roots["node"], "left").select(
        "key", "cls", F.coalesce("root", "cls").alias("root"))
    parts = named.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 <> r1")
    open_sets = scratch(sets.join(unsent(named.join(unsent(parts.select("key")), "key").select("cls").distinct()), "cls"), "open")
    across = _prefix_pairs(open_sets, roots, num, den).join(unsent(near), ["u", "v"], "left_anti")
    more = scratch(_confirm(across, open_sets, num, den), "links")
    out = components(good.unionByName(more))
    release(keys, rows, near, sets, open_sets)
    return out


def _grouped(docs: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """Columns of ``docs`` (doc_id, text, maybe key) but text, with n_shingles and first.

    first: the smallest (null id, doc_id[, key]) of the row's group; null where
    the row has no shingles.
    """
    signed = scratch(signatures(docs, shingle), "signatures")
    row = F.struct(F.col("doc_id").isNull().alias("null_id"), *[c for c in docs.columns if c != "text"])
    classes = scratch(
        signed.where("n_shingles > 0").groupBy("digest")
        .agg(F.min(row).alias("first"), F.first("n_shingles").alias("n_shingles"), F.first("a").alias("a"),
             F.first("b").alias("b")).withColumn("doc_id", F.col("first.doc_id"))
        .withColumn("cls", F.monotonically_increasing_id()), "classes")
    roots = links(docs, classes, shingle, num, den)
    placed = classes.select("cls", "digest", "first").join(unsent(roots), F.col("cls") == F.col("node"), "left").select(
        "digest", "first", F.coalesce("root", "cls").alias("root"))
    named = placed.select("root", "digest").join(
        unsent(placed.groupBy("root").agg(F.min("first").alias("first"))), "root").select("digest", "first")
    return signed.join(unsent(named), "digest", "left").select(
        *[c for c in docs.columns if c != "text"], "n_shingles", "first")


def near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return (_grouped(docs, shingle, num, den)
            .select("doc_id", "n_shingles", F.coalesce("first.doc_id", "doc_id").alias("component_id"))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


SLOTS = 1 << 18


@others_packed
def without_near_duplicates(docs: DataFrame, shingle: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs`` for each group, with all its columns: the smallest id.

    Rows are judged by id and text, so null and repeated ids stand for each of
    their texts: of several texts of the smallest id in a group one stays, and
    a null id only in a group without another.  Rows without words are in no
    group.  Rows with equal id and text count once.  Only rows that share a
    hash slot with a dropped or repeated row are shuffled; the slots (at most
    SLOTS) are broadcast, and no other table is.
    """
    doc_id, key = F.col("doc_id").cast("long"), F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    grouped = _grouped(docs.select(doc_id.alias("doc_id"), key.alias("key"), "text"), shingle, num, den)
    best = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key"))
    judged = scratch(grouped.select("doc_id", "key", (F.col("first").isNull() | best).alias("kept")), "judged")
    # Equal id and text, equal judgement.
    some = judged.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).where(
        "n > 1 or not kept")
    slots = F.broadcast(some.select(F.xxhash64("doc_id", "key").bitwiseAND(SLOTS - 1).alias("_slot")).distinct())
    rows = docs.withColumn("_key", key).withColumn("_slot", F.xxhash64(doc_id, "_key").bitwiseAND(SLOTS - 1))
    doubtful = rows.join(slots, "_slot", "left_semi").drop("_slot")
    gone = some.where("not kept").select(F.col("doc_id").alias("_gone"), F.col("key").alias("_gone_key"))
    stay = (doubtful.join(unsent(gone), (doubtful["_key"] == F.col("_gone_key")) & doubtful["doc_id"].cast("long").eqNullSafe(
                F.col("_gone")), "left_anti").drop("_key").dropDuplicates(["doc_id", "text"]))
    return rows.join(slots, "_slot", "left_anti").drop("_slot", "_key").unionByName(stay)
