"""Hard negatives by BOND: a vertical scan of vectors that are stored by dimension.

1. Tasks turn rows into blocks: one integer column for each dimension, beside
   ids and labels.  Rows that are anchors go into blocks of anchors too.
2. Blocks are dealt into parts and anchors into groups, both of bounded bytes;
   every part meets every group in one task (a grid of parts and groups).
3. In such a task an anchor reads a block's columns in the order of its own
   falling magnitudes.  After each few dimensions the least and the largest
   contribution that the block's remaining columns can make bound every row's
   score; rows that cannot be among the wanted ones leave the bitmap.
4. First scan: rows of the anchor's label, the best ``positives``.  Second scan:
   rows of other labels, for each positive the best ``negatives`` scores in the
   window from num/den of the positive's score up to that score.
   The best of a part are at most that many rows; a window with a rank limit
   merges the parts.

Scores are integer inner products, so bounds and results are exact: float32 or
float64 where no sum can be rounded, Python integers beyond.

Defined results: rows with a null label, a null vector or a null or non-finite
entry take no part; a shorter vector counts as padded by zeros; equal scores go
by smaller id, null ids last; a row is not its own positive, but another row of
the same id may be; anchors that repeat an id are anchors each; positives with a
negative score have no window; an empty table gives no rows.  A score beyond 64
bits raises OverflowError.  Other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tunelake.llm.common import pack, partitions, scratch, unpack
from tunelake.llm.whitening import finite_rows

SCALE = 256
POSITIVES = NEGATIVES = 5
BLOCK = 8192                   # rows of a block
PART_BYTES = 32 << 20          # blocks of a part, and anchors of a group, as stored
STEPS = (16, 8, 8, 8, 8, 8)    # dimensions read between two looks at the bitmap; the last is repeated
LAST = np.iinfo(np.int64).max

_BLOCKS = "anchors boolean, bytes long, blob binary"


@dataclass
class Block:
    key: np.ndarray      # number of the row in the table of blocks
    vec_id: np.ndarray   # LAST where null
    no_id: np.ndarray
    label: np.ndarray
    columns: np.ndarray  # dimensions by rows, int64 or Python integers

    @staticmethod
    def of(blob: bytes) -> Block:
        key, vec_id, no_id, label, flat, exact = unpack(blob)
        if exact.size:
            flat = np.array([int(v) for v in bytes(exact).decode().split(",")], object)
        return Block(key, vec_id, no_id.astype(bool), label, flat.reshape(-1, len(key)) if len(key) else flat.reshape(0, 0))

    def blob(self) -> bytes:
        flat, exact = self.columns.ravel(), np.zeros(0, np.uint8)
        big = max((abs(int(v)) for v in (flat.max(), flat.min())), default=0) if flat.size else 0
        if big >= 1 << 62:  # beyond 64 bits: as text
            flat, exact = np.zeros(0, np.int8), np.frombuffer(",".join(str(v) for v in flat).encode(), np.uint8)
        else:
            flat = flat.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if big <= np.iinfo(t).max))
        return pack(self.key, self.vec_id, self.no_id.astype(np.uint8), self.label, flat, exact)


def _whole(x: np.ndarray) -> np.ndarray:
    """floor as integers; Python's where 64 bits are not enough."""
    x = np.floor(x)
    if np.abs(x).max(initial=0.0) < 2.0 ** 62:
        return x.astype(np.int64)
    return np.array([int(v) for v in x.ravel()], object).reshape(x.shape)


def _to_blocks(scale):
    def run(batches):
        task, made = TaskContext.get().partitionId(), 0
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                rows, c = finite_rows(part.column(3))
                if not len(rows):
                    continue
                ids = part.column(0).take(pa.array(rows))
                none = np.asarray(ids.is_null())
                key = (np.int64(task) << 40) + made + np.arange(len(rows))
                made += len(rows)
                block = Block(key, ids.fill_null(LAST).to_numpy(zero_copy_only=False), none,
                              part.column(1).take(pa.array(rows)).to_numpy(zero_copy_only=False),
                              np.ascontiguousarray(_whole(scale * c).T))
                anchor = np.flatnonzero(part.column(2).take(pa.array(rows)).to_numpy(zero_copy_only=False))
                for is_anchor, some in ((False, None), (True, anchor)):
                    one = block if some is None else Block(key[some], block.vec_id[some], none[some],
                                                           block.label[some], block.columns[:, some])
                    if len(one.key):
                        blob = one.blob()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([is_anchor]), pa.array([len(blob)], pa.int64()), pa.array([blob], pa.binary())],
                            names=["anchors", "bytes", "blob"])
    return run


def _padded(m: np.ndarray, d: int) -> np.ndarray:
    return m if len(m) == d else np.vstack((m, np.zeros((d - len(m), m.shape[1]), m.dtype)))


def _exact_type(a: np.ndarray, x: np.ndarray):
    """The type whose sums of products are exact."""
    def largest(m):
        return max(abs(int(m.max())), abs(int(m.min()))) if m.size else 0
    bound = largest(a) * largest(x) * max(1, len(a))
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else object


class Scan:
    """Columns of a block and what each of them can contribute at least and at most."""

    def __init__(self, columns: np.ndarray):
        self.x = columns
        self.least, self.most = columns.min(axis=1), columns.max(axis=1)

    def scores(self, a: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows that ``keep(partial, low, high)`` never drops, with their scores; low and high bound what
        is still to come, and both are 0 at the end."""
        order = np.argsort(-np.abs(a), kind="stable")
        ends = [self.least[order] * a[order], self.most[order] * a[order]]
        low = np.concatenate((np.cumsum(np.minimum(*ends)[::-1])[::-1], [0]))
        high = np.concatenate((np.cumsum(np.maximum(*ends)[::-1])[::-1], [0]))
        partial, at, step = np.zeros(len(rows), self.x.dtype), 0, 0
        while at < len(order):
            dims = order[at:at + STEPS[min(step, len(STEPS) - 1)]]
            partial = partial + a[dims] @ self.x[np.ix_(dims, rows)]
            at, step = at + len(dims), step + 1
            stays = keep(partial, low[at], high[at])
            if not stays.all():
                rows, partial = rows[stays], partial[stays]
            if not len(rows):
                break
        return rows, partial


def _kth(values: np.ndarray, k: int):
    """The k-th largest, None where there are fewer."""
    if len(values) < k:
        return None
    return np.partition(values, len(values) - k)[len(values) - k] if values.dtype != object else sorted(values)[-k]


def _best(scores, ids, keys, k):
    """Order of the k best: falling score, then id, then row."""
    if scores.dtype != object:
        order = np.lexsort((keys, ids, -scores))
    else:
        order = np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i], keys[i])), np.int64)
    return order[:k]


def _long(score) -> int:
    score = int(score)
    if not -(1 << 63) <= score < 1 << 63:
        raise OverflowError("a score does not fit into 64 bits")
    return score


def _of_label(anchors: Block, blocks, k: int):
    """Rows (anchor, anchor_id, label, score, vec_id, row): each anchor's k best rows of its label in these blocks."""
    best = [([], [], [], []) for _ in anchors.key]  # score, id, key, no_id of the best so far
    for block in blocks:
        d = max(len(block.columns), len(anchors.columns))
        kind = _exact_type(anchors.columns, block.columns)
        a, x = _padded(anchors.columns, d).astype(kind), _padded(block.columns, d).astype(kind)
        for label in np.intersect1d(block.label, anchors.label):
            mine = np.flatnonzero(block.label == label)
            scan, n = Scan(np.ascontiguousarray(x[:, mine])), np.arange(len(mine))
            for i in np.flatnonzero(anchors.label == label):
                rows = n[block.key[mine] != anchors.key[i]]
                floor = best[i][0][k - 1] if len(best[i][0]) >= k else None

                def keep(partial, low, high, floor=floor):
                    t = _kth(partial + low, k)
                    t = floor if t is None else t if floor is None else max(t, floor)
                    return np.ones(len(partial), bool) if t is None else partial + high >= t

                rows, scores = scan.scores(a[:, i], rows, keep)
                at = mine[rows]
                some = _best(scores, block.vec_id[at], block.key[at], k)
                merged = [list(old) + list(new[some]) for old, new in zip(best[i], (
                    scores, block.vec_id[at], block.key[at], block.no_id[at]))]
                order = sorted(range(len(merged[0])), key=lambda j: (-merged[0][j], merged[1][j], merged[2][j]))[:k]
                best[i] = tuple([m[j] for j in order] for m in merged)
    return [(int(anchors.key[i]), int(anchors.vec_id[i]), _long(s), None if none else int(v), int(r))
            for i, found in enumerate(best) for s, v, r, none in zip(*found)]


def _in_windows(anchors: Block, blocks, windows: dict, k: int):
    """Rows (anchor, positive, score, vec_id, row): for each window of each anchor the k best rows of other
    labels whose score lies in it, among these blocks.  ``windows``: anchor -> [(positive, low, high)]."""
    best: dict = {}
    for block in blocks:
        d = max(len(block.columns), len(anchors.columns))
        kind = _exact_type(anchors.columns, block.columns)
        a, x = _padded(anchors.columns, d).astype(kind), _padded(block.columns, d).astype(kind)
        scan = Scan(x)
        others = {label: np.flatnonzero(block.label != label) for label in np.unique(anchors.label)}
        for i, key in enumerate(anchors.key.tolist()):
            wanted = windows.get(key)
            if not wanted:
                continue
            floors = [max(lo, best[key, p][k - 1][0]) if len(best.get((key, p), ())) >= k else lo for p, lo, _ in wanted]

            def keep(partial, low, high):
                stays = np.zeros(len(partial), bool)
                for (_, lo, hi), floor in zip(wanted, floors):
                    t = _kth(partial[(partial + low >= lo) & (partial + high <= hi)], k)
                    t = floor if t is None else max(floor, t + low)
                    stays |= (partial + high >= t) & (partial + low <= hi)
                return stays

            rows, scores = scan.scores(a[:, i], others[anchors.label[i]], keep)
            if not len(rows):
                continue
            for p, lo, hi in wanted:
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                at = rows[inside]
                some = _best(scores[inside], block.vec_id[at], block.key[at], k)
                new = [(int(scores[inside[j]]), int(block.vec_id[at[j]]), int(block.key[at[j]]), bool(block.no_id[at[j]]))
                       for j in some]
                if new:
                    best[key, p] = sorted(best.get((key, p), []) + new, key=lambda r: (-r[0], r[1], r[2]))[:k]
    return [(key, p, _long(s), None if none else v, r) for (key, p), found in best.items() for s, v, r, none in found]


_FOUND = "anchor long, anchor_id long, score long, vec_id long, row long"
_MINED = "anchor long, positive int, score long, vec_id long, row long"


def _frame(rows, schema: str) -> pd.DataFrame:
    return pd.DataFrame({name: pd.array([r[i] for r in rows], "Int32" if kind == "int" else "Int64")
                         for i, (name, kind) in enumerate(c.split() for c in schema.split(", "))})


def _groups(blobs):
    return [Block.of(b) for b in blobs]


def _positive_task(k):
    def run(blocks, anchors):
        rows = []
        if len(blocks) and len(anchors):
            mine = _groups(blocks["blob"])
            for some in _groups(anchors["side"]):
                rows += _of_label(some, mine, k)
        return _frame(rows, _FOUND)
    return run


def _negative_task(k):
    def run(blocks, anchors):
        rows = []
        if len(blocks) and len(anchors):
            mine = _groups(blocks["blob"])
            windows = {}
            for w in anchors["windows"]:
                if w is not None:
                    for a, p, lo, hi in np.frombuffer(w, np.int64).reshape(-1, 4).tolist():
                        windows.setdefault(a, []).append((p, lo, hi))
            for blob in anchors["side"]:
                if blob is not None:
                    rows += _in_windows(Block.of(blob), mine, windows, k)
        return _frame(rows, _MINED)
    return run


def _pack_windows(num: int, den: int):
    """Windows of some anchors of a group as one array of (anchor, positive, low, high)."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        low = [-((-int(s) * num) // den) for s in frame["positive_score"]]
        rows = np.column_stack([frame["anchor"], frame["positive"], np.array(low, np.int64), frame["positive_score"]])
        return pd.DataFrame({"g": [frame["g"].iloc[0]], "windows": [rows.astype(np.int64).tobytes()]})
    return run


def _ranked(rows: DataFrame, keys: list, k: int, name: str) -> DataFrame:
    """The k best of each key: a window with a rank limit, which Spark applies before the shuffle too."""
    by = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row")
    return rows.withColumn(name, F.row_number().over(by)).where(F.col(name) <= k)


def hard_negatives(vectors: DataFrame, anchors: Column, id_col: str = "vec_id", column: str = "embedding",
                   label: str = "label", scale: int = SCALE, num: int = 80, den: int = 100,
                   positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchors`` holds."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col(label).isNotNull() & F.col(column).isNotNull()).select(
        F.col(id_col).cast("long").alias("a"), F.col(label).cast("long").alias("b"),
        F.coalesce(anchors, F.lit(False)).alias("c"), F.col(column).alias("d"))
    table = scratch(rows.mapInArrow(_to_blocks(scale), _BLOCKS), "blocks")
    sizes = {r["anchors"]: r["b"] for r in table.groupBy("anchors").agg(F.sum("bytes").alias("b")).collect()}  # two rows
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, "
                                      "positive_score long, negative_score long")
    if True not in sizes:
        return empty
    n_parts = max(partitions(spark), -(-sizes[False] // PART_BYTES))
    n_groups = -(-sizes[True] // PART_BYTES)

    def dealt(n):  # by content: the same however often a lost task is run again
        return F.pmod(F.xxhash64("blob"), F.lit(n)).cast("int")

    def every(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    blocks = table.where(~F.col("anchors")).select(dealt(n_parts).alias("p"), every(n_groups).alias("g"), "blob")
    some = table.where("anchors").select(dealt(n_groups).alias("g"), F.col("blob").alias("side"))
    spread = some.select(every(n_parts).alias("p"), "g", "side")
    found = blocks.groupBy("p", "g").cogroup(spread.groupBy("p", "g")).applyInPandas(_positive_task(positives), _FOUND)
    best = scratch(_ranked(found, ["anchor"], positives, "positive").select(
        "anchor", "anchor_id", "positive", F.col("score").alias("positive_score"), F.col("vec_id").alias("positive_id")),
        "positives")

    # Windows go to the group of their anchor, packed once for each group.
    of_group = some.mapInPandas(_anchor_keys, "anchor long, g int")
    windows = best.where("positive_score >= 0").join(of_group, "anchor").select("g", "anchor", "positive", "positive_score")
    packed = windows.withColumn("s", F.pmod("anchor", F.lit(n_parts))).groupBy("g", "s").applyInPandas(
        _pack_windows(num, den), "g int, windows binary")
    sides = some.select("g", "side", F.lit(None).cast("binary").alias("windows")).unionByName(
        packed.select("g", F.lit(None).cast("binary").alias("side"), "windows"))
    sides = sides.select(every(n_parts).alias("p"), "g", "side", "windows")
    mined = blocks.groupBy("p", "g").cogroup(sides.groupBy("p", "g")).applyInPandas(_negative_task(negatives), _MINED)
    return (_ranked(mined, ["anchor", "positive"], negatives, "rank").join(best, ["anchor", "positive"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score")))


def _anchor_keys(frames):
    for frame in frames:
        for g, blob in zip(frame["g"], frame["side"]):
            yield pd.DataFrame({"anchor": Block.of(blob).key, "g": np.int32(g)})
