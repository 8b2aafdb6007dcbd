"""Removal of repeated byte strings by a Burrows-Wheeler transform.

Every byte covered by a string of ``length`` bytes that also starts in a
document with a smaller id goes.  Three distributed steps find those strings:

1. Anchors.  The smallest hash of the 24-byte strings inside a window of
   ``length`` bytes depends on its bytes alone, so equal windows have equal
   anchors.  Anchors are sent by hash; one is shared if two documents have it
   with equal bytes on its left or on its right, as far as any common window
   must reach on one of the sides.
2. Segments.  Runs of windows under a shared anchor are sent by that anchor,
   so equal windows meet in one task.  There the distinct segments are joined
   to texts of about BATCH_BYTES (an anchor's stay together), whose Burrows-Wheeler transform is built (from suffixes in the order of their first
   ``length`` symbols, which is all that is asked of it), and intervals are expanded backward, breadth first, which finds common prefixes by increasing
   length; it stops at ``length``.  Borders not found by then part suffixes
   with equal first ``length`` bytes: such a class takes its smallest document.
3. Ranges of removed bytes are gathered by document.

Hot strings: a task sends one document for each anchor or segment it holds,
and answers for its other documents itself, so a passage of a third of all
documents is as many rows as there are tasks.  Texts cross the network only
for documents with a shared anchor, or with removed bytes: a table of hash
slots, of fixed size, is broadcast to leave the others where they are.

Cases: null and empty texts have no bytes; texts shorter than ``length`` keep
all; documents of any length are read whole; a null id counts as larger than
any other; rows with the same id don't remove each other's bytes; equal rows
(same id and text) get equal results; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from tunelake.llm.common import deltas, in_slices, no_collector, others_packed, pack, partitions, release, scratch, undeltas, unpack, unsent

LENGTH, GRAM = 50, 24
SLOTS = 1 << 18
GROUP_BYTES, CHUNK_BYTES, BATCH_BYTES = 8 << 20, 1 << 19, 1 << 17
LAST_ID = np.iinfo(np.int64).max  # stands for a null id

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTE = np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM (16 + 8) bytes from each place on."""
    h = _BYTE[raw]
    for size in (1, 2, 4, 8):
        if size == 8:
            eight = h
        h = _mix(h[:-size] * _ODD + h[size:])
    return _mix(h[:len(raw) - GRAM + 1] * _ODD + eight[16:16 + len(raw) - GRAM + 1])


def _side_marks(h: np.ndarray, at: np.ndarray, owner: np.ndarray, ends: np.ndarray, length: int):
    """16-bit marks of the grams with the bytes that a window has on their left, or on their right.

    A window holds length - GRAM bytes beside its anchor: at least half of them
    on one side.  Grams that overlap the anchor's stand for these bytes.  0: the
    document has no room there.
    """
    half = (length - GRAM + 1) // 2
    begin = np.r_[0, ends[:-1]][owner]
    left, right = at - half >= begin, at + GRAM + half <= ends[owner]
    marks = []
    for has, other in ((left, at - half), (right, at + half)):
        both = _mix(h[at] * _ODD + h[np.clip(other, 0, len(h) - 1)])
        marks.append(np.where(has, (both >> np.uint64(48)) | np.uint64(1), np.uint64(0)).astype(np.uint16))
    return marks


def _sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """best of every ``width`` successive values."""
    size = 1
    while 2 * size <= width:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[:len(x) - (width - size)], x[width - size:]) if size < width else x


def window_minima(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes, smallest one of each window, and whether the window lies in one document."""
    h = _gram_hashes(raw)
    m = _sliding(h, length - GRAM + 1, np.minimum)
    inside = np.ones(len(m) + length, bool)
    for k in range(1, length):
        inside[ends[:-1] - k] = False  # windows over a border
    return h, m, inside[:len(m)]


def _chunks(ids, keys, texts):
    """Documents joined to buffers of about CHUNK_BYTES: (ids, keys, raw, ends)."""
    some, held = [], 0
    for row in zip(ids, keys, texts):
        some.append(row)
        held += len(row[2])
        if held >= CHUNK_BYTES:
            yield _joined(some)
            some, held = [], 0
    if some:
        yield _joined(some)


def _joined(some):
    raw = np.frombuffer(b"".join([r[2] for r in some]), np.uint8)
    return (np.asarray([r[0] for r in some], np.int64), np.asarray([r[1] for r in some], np.uint32), raw,
            np.cumsum([len(r[2]) for r in some]))


def _read(batch, length):
    """ids, checksums and bytes of the documents that have a window."""
    for d, t in zip(batch["doc_id"], batch["text"]):
        raw = t.encode()
        if len(raw) >= length:
            yield d, zlib.crc32(raw), raw


def _owner(places: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return np.searchsorted(ends, places, side="right")


# --- step 1: shared anchors --------------------------------------------------------

def _send_anchors(parts: int, length: int):
    def flush(found, turn):
        ids, keys = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
        base = np.cumsum([0] + [len(f[0]) for f in found])
        anchors = np.concatenate([f[2] for f in found])
        docs = np.concatenate([f[3] + b for f, b in zip(found, base)])
        left, right = (np.concatenate([f[k] for f in found]) for k in (4, 5))
        # What this group shares is settled here; of each anchor, mark and side one row goes on.
        settled, send = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
        for mark in (left, right):
            shared, first = _shared(anchors, mark, ids[docs])
            settled |= shared
            send |= first
        send |= ~settled
        out = []
        if settled.any():
            out.append((turn % parts, 1, _anchor_blob(anchors, docs, left, right, ids, keys, settled, settled)))
        part = (anchors >> np.uint64(40)).astype(np.int64) % parts
        for p, at in _by_part(np.where(send, part, -1), parts):
            chosen = np.zeros(len(anchors), bool)
            chosen[at] = True
            out.append((p, 0, _anchor_blob(anchors, docs, left, right, ids, keys, chosen, ~settled)))
        return pd.DataFrame(out, columns=["part", "kind", "blob"])

    def run(batches):
        found, held, turn = [], 0, TaskContext.get().partitionId()
        for b in batches:
            rows = list(_read(b, length))
            for ids, keys, raw, ends in _chunks(*zip(*rows)) if rows else ():
                h, m, inside = window_minima(raw, ends, length)
                seen = _sliding(np.pad(np.where(inside, m, np.uint64(0)), (length - GRAM,)),
                                length - GRAM + 1, np.maximum)
                at = np.flatnonzero(seen == h)
                owner = _owner(at, ends)
                found.append((ids, keys, h[at], owner, *_side_marks(h, at, owner, ends, length)))
                held += len(raw)
            if held >= GROUP_BYTES:
                yield flush(found, turn)
                found, held, turn = [], 0, turn + 1
        if found:
            yield flush(found, turn)
    return run


def _by_part(part: np.ndarray, parts: int):
    order = np.argsort(part, kind="stable")
    cut = np.searchsorted(part[order], np.arange(parts + 1))
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            yield p, order[cut[p]:cut[p + 1]]


def _shared(anchors, mark, ids) -> tuple[np.ndarray, np.ndarray]:
    """Rows whose anchor and mark occur with another id too, and one row for each anchor and mark."""
    order = np.lexsort((mark, anchors))
    a, m, d = anchors[order], mark[order], ids[order]
    start = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (m[1:] != m[:-1])])
    many = (np.minimum.reduceat(d, start) != np.maximum.reduceat(d, start)) & (m[start] != 0)
    shared, first = np.zeros(len(a), bool), np.zeros(len(a), bool)
    shared[order] = np.repeat(many, np.diff(np.r_[start, len(a)]))
    first[order[start]] = True
    return shared, first


def _anchor_blob(anchors, docs, left, right, ids, keys, chosen, open_) -> bytes:
    at = np.flatnonzero(chosen)
    at = at[np.argsort(anchors[at], kind="stable")]
    used, local = np.unique(docs[at], return_inverse=True)
    return pack(deltas(anchors[at]), local.astype(np.uint32), left[at], right[at], ids[used], keys[used], open_[at])


def _meet_anchors(part: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, crc, anchor) of every shared anchor."""
    out, met = [], []
    for kind, blob in zip(part["kind"], part["blob"]):
        anchors, local, left, right, ids, keys, open_ = unpack(blob)
        row = undeltas(anchors), ids[local], keys[local], open_, left, right
        (out if kind else met).append(row)
    frames = [pd.DataFrame({"doc_id": d, "crc": k.astype(np.int64), "anchor": a.astype(np.int64)})
              for a, d, k, *_ in out]
    if met:
        anchors, ids, keys, open_, left, right = (np.concatenate([m[i] for m in met]) for i in range(6))
        # A row that its group has settled stands for several documents: it is an id of its own.
        who = np.where(open_, ids, np.iinfo(np.int64).min)
        good = open_ & (_shared(anchors, left, who)[0] | _shared(anchors, right, who)[0])
        frames.append(pd.DataFrame({"doc_id": ids[good], "crc": keys[good].astype(np.int64),
                                    "anchor": anchors[good].astype(np.int64)}))
    return pd.concat(frames) if frames else pd.DataFrame({"doc_id": [], "crc": [], "anchor": []})


# --- step 2: segments ----------------------------------------------------------------

def _send_segments(parts: int, length: int):
    def flush(segments, turn):
        """segments: bytes -> {(doc, crc): [offsets]}; the texts of the smallest document go on, the others are settled."""
        settled, sent = [], {}
        for (anchor, raw), docs in segments.items():
            least = min(docs)[0]
            for (d, crc), offsets in docs.items():
                if d != least:
                    settled += [(d, crc, o, o + len(raw)) for o in offsets]
                else:
                    sent.setdefault((anchor >> 40) % parts, []).append((raw, d, crc, offsets, anchor))
        out = []
        if settled:
            s = np.asarray(settled, np.int64)
            out.append((turn % parts, 1, pack(*s.T)))
        for p, rows in sent.items():
            sizes = np.asarray([len(r[0]) for r in rows], np.uint32)
            n = np.asarray([len(r[3]) for r in rows], np.uint32)
            offsets = np.asarray([o for r in rows for o in r[3]], np.uint32)
            out.append((p, 0, pack(np.frombuffer(b"".join([r[0] for r in rows]), np.uint8), sizes,
                                   np.asarray([r[1] for r in rows], np.int64),
                                   np.asarray([r[2] for r in rows], np.uint32), n, offsets,
                                   np.asarray([r[4] for r in rows], np.uint64))))
        return pd.DataFrame(out, columns=["part", "kind", "blob"])

    def run(batches):
        with no_collector():
            yield from sent(batches)

    def sent(batches):
        segments, held, turn = {}, 0, TaskContext.get().partitionId()
        for b in batches:
            known = {}
            rows = []
            for (d, crc, raw), anchors in zip(_read(b, length), b["anchors"]):
                rows.append((d, crc, raw))
                known[len(rows) - 1] = anchors
            for base, (ids, keys, raw, ends) in _numbered(_chunks(*zip(*rows)) if rows else ()):
                _, m, inside = window_minima(raw, ends, length)
                wanted = np.concatenate([np.asarray(known[base + k], np.int64) for k in range(len(ids))])
                owner = np.repeat(np.arange(len(ids)), [len(known[base + k]) for k in range(len(ids))])
                at = np.flatnonzero(inside)
                if not len(at):
                    continue
                # Runs of windows with one anchor in one document.
                doc = _owner(at, ends)
                cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(m[at]) != 0) | (np.diff(doc) != 0)])
                start, stop, doc = at[cut], at[np.r_[cut[1:], len(at)] - 1] + length, doc[cut]
                # An anchor counts for the documents that share it.
                fits = np.isin(m[start], wanted.view(np.uint64))
                start, stop, doc = start[fits], stop[fits], doc[fits]
                fits = np.isin(_mix(m[start]) + doc.astype(np.uint64),
                               _mix(wanted.view(np.uint64)) + owner.astype(np.uint64))
                start, stop, doc = start[fits], stop[fits], doc[fits]
                begin = np.r_[0, ends[:-1]]
                whole = raw.tobytes()
                for a, s, e, k in zip(m[start].tolist(), start.tolist(), stop.tolist(), doc.tolist()):
                    seg = whole[s:e]
                    seen = segments.setdefault((a, seg), {})
                    row = int(ids[k]), int(keys[k])  # null and repeated ids have several texts
                    if row in seen:
                        seen[row].append(s - int(begin[k]))
                    else:
                        seen[row] = [s - int(begin[k])]
                        held += 300
            if held >= GROUP_BYTES:
                yield flush(segments, turn)
                segments, held, turn = {}, 0, turn + 1
        if segments:
            yield flush(segments, turn)
    return run


def _numbered(chunks):
    base = 0
    for c in chunks:
        yield base, c
        base += len(c[0])


def _ranked(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Places in the order of ``key``, the rank of each place (equal keys, equal ranks) and the last rank."""
    order = np.argsort(key)
    k = key[order]
    steps = np.cumsum(k[1:] != k[:-1])
    rank = np.zeros(len(key), np.int64)
    rank[order[1:]] = steps
    return order, rank, int(steps[-1]) if len(steps) else 0


def suffix_order(t: np.ndarray, length: int) -> np.ndarray:
    """Suffixes of ``t`` (symbols 0 to 256) in the order of their first ``length`` symbols or more."""
    n = len(t)
    key = np.zeros(n, np.int64)
    padded = np.pad(t.astype(np.int64) + 1, (0, 7))
    for k in range(7):
        key = key * 259 + padded[k:n + k]
    order, rank, last = _ranked(key)
    size = 7
    while size < length and last < n - 1:
        after = np.zeros(n, np.int64)
        if size < n:
            after[:n - size] = rank[size:] + 1
        order, rank, last = _ranked(rank * (n + 1) + after)
        size *= 2
    return order


def class_borders(t: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For each place in suffix order, whether fewer than ``length`` symbols agree with the one before.

    Backward extension of intervals, breadth first: the interval of ``c w``
    ends where suffixes stop to agree after ``|w|`` symbols, so the values
    appear in increasing order and ``length`` rounds are enough.  An interval
    whose end is known already has nothing new to its left.
    """
    n = len(t)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    step = place[order - 1]       # place of the suffix that starts one symbol earlier
    symbol = t[order]             # first symbol of each place
    border = np.zeros(n + 1, bool)
    border[0] = True
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    of = np.empty(n, np.int64)
    for _ in range(length):
        size = hi - lo
        # All places of all intervals, and where they go by one symbol to the left.
        goal = step[np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())]
        owner = np.repeat(np.arange(len(lo)), size)
        if len(goal) > n // 8:
            of.fill(-1)
            of[goal] = owner
            at = np.flatnonzero(of >= 0)
            owner = of[at]
        else:
            by = np.argsort(goal)
            at, owner = goal[by], owner[by]
        cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(owner) != 0) | (np.diff(symbol[at]) != 0)])
        lo, hi = at[cut], at[np.r_[cut[1:], len(at)] - 1] + 1
        new = ~border[hi]
        lo, hi = lo[new], hi[new]
        border[hi] = True
        if not len(lo):
            break
    return border[:n]


def least_documents(texts: list[bytes], docs: np.ndarray, length: int) -> np.ndarray:
    """For each byte of the joined texts: the smallest document with the ``length`` bytes from there on.

    Places with fewer bytes left in their text have none (LAST_ID).
    """
    sizes = np.asarray([len(x) for x in texts])
    joined = b"\0".join([b""] + texts)  # room for a separator before each text
    t = np.frombuffer(joined, np.uint8).astype(np.int16) + 1
    start = np.cumsum(sizes + 1) - sizes
    t[start - 1] = 0
    t = np.append(t, np.int16(0))
    order = suffix_order(t, length)
    border = class_borders(t, order, length)
    left = np.zeros(len(t), np.int64)
    whole = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.repeat(start, sizes) + whole
    left[at] = np.repeat(sizes, sizes) - whole
    doc = np.full(len(t), LAST_ID)
    doc[at] = np.repeat(docs, sizes)
    doc[left < length] = LAST_ID
    first = np.flatnonzero(border)
    least = np.repeat(np.minimum.reduceat(doc[order], first), np.diff(np.r_[first, len(t)]))
    out = np.empty(len(t), np.int64)
    out[order] = least
    out[left < length] = LAST_ID
    return out[at]


def _meet_segments(length: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        with no_collector():
            return met(part)

    def met(part: pd.DataFrame) -> pd.DataFrame:
        out, rows = [], []
        for kind, blob in zip(part["kind"], part["blob"]):
            if kind:
                out.append(np.stack(unpack(blob)))
                continue
            raw, sizes, ids, keys, n, offsets, anchors = unpack(blob)
            raw, at, o = raw.tobytes(), np.r_[0, np.cumsum(sizes)].tolist(), np.r_[0, np.cumsum(n)].tolist()
            rows += [(anchor, raw[at[k]:at[k + 1]], d, key, offsets[o[k]:o[k + 1]]) for k, (anchor, d, key) in enumerate(
                zip(anchors.tolist(), ids.tolist(), keys.tolist()))]
        rows.sort(key=lambda r: r[:4])
        ranges: list[tuple[int, int, int, int]] = []
        batch, held = [], 0
        for anchor, group in groupby(rows, key=lambda r: r[0]):
            texts = []  # of this anchor: (bytes, smallest document, rows of that document)
            for _, raw, d, crc, offsets in group:
                if texts and texts[-1][0] == raw:
                    if d != texts[-1][1]:  # a smaller document has the whole segment
                        ranges += [(d, crc, x, x + len(raw)) for x in offsets.tolist()]
                        continue
                else:
                    texts.append((raw, d, []))
                texts[-1][2].append((crc, offsets))
            if len(texts) > 1:  # equal windows have equal anchors: one text alone loses nothing
                batch += texts
                held += sum(len(t[0]) for t in texts)
            if held >= BATCH_BYTES:
                ranges += _ranges(batch, length)
                batch, held = [], 0
        if batch:
            ranges += _ranges(batch, length)
        if ranges:
            out.append(np.asarray(ranges, np.int64).T)
        whole = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
        return pd.DataFrame(dict(zip(("doc_id", "crc", "start", "stop"), whole)))
    return run


def _ranges(batch: list, length: int) -> list[tuple[int, int, int, int]]:
    """(doc_id, crc, start, stop) of what smaller documents in the batch have too."""
    docs = np.asarray([b[1] for b in batch], np.int64)
    sizes = np.asarray([len(b[0]) for b in batch])
    begin = np.cumsum(sizes) - sizes
    gone = least_documents([b[0] for b in batch], docs, length) < np.repeat(docs, sizes)
    at = np.flatnonzero(gone)
    if not len(at):
        return []
    text = np.repeat(np.arange(len(batch)), sizes)[at]
    cut = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (np.diff(text) != 0)])
    which = text[cut]
    lo, hi = at[cut] - begin[which], at[np.r_[cut[1:], len(at)] - 1] + length - begin[which]
    return [(batch[w][1], crc, x + a, x + b) for w, a, b in zip(which.tolist(), lo.tolist(), hi.tolist())
            for crc, offsets in batch[w][2] for x in offsets.tolist()]


# --- operator ----------------------------------------------------------------------------

def _slots(keys: DataFrame) -> DataFrame:
    """Hash slots of the ids in ``keys``: at most SLOTS rows."""
    return keys.select((F.xxhash64("doc_id").bitwiseAND(SLOTS - 1)).alias("_slot")).distinct()


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, crc, spans) of the documents that lose bytes; spans: sorted disjoint (start, stop) of bytes.

    doc_id LAST_ID stands for null, crc is the checksum of the text's bytes.
    """
    if length < GRAM + 1:
        raise ValueError(f"length must be over {GRAM}")
    parts = 2 * partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID))).alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    blob = "part int, kind int, blob binary"
    shared = scratch(
        rows.mapInArrow(in_slices(_send_anchors(parts, length)), blob)
        .groupBy("part").applyInPandas(_meet_anchors, "doc_id long, crc long, anchor long"), "anchors")
    listed = shared.groupBy("doc_id", "crc").agg(F.collect_set("anchor").alias("anchors"))
    near = rows.withColumn("_slot", F.xxhash64("doc_id").bitwiseAND(SLOTS - 1)).join(
        F.broadcast(_slots(shared)), "_slot", "left_semi")
    held = (near.withColumn("crc", F.crc32(F.col("text").cast("binary")))
            .join(unsent(listed), ["doc_id", "crc"]).select("doc_id", "text", "anchors"))
    ranges = scratch(
        held.mapInArrow(in_slices(_send_segments(parts, length)), blob)
        .groupBy("part").applyInPandas(_meet_segments(length), "doc_id long, crc long, start long, stop long"), "ranges")
    release(shared)
    spans = F.aggregate(
        F.sort_array(F.collect_set(F.struct("start", "stop"))),
        F.array().cast("array<struct<start:bigint,stop:bigint>>"),
        lambda acc, r: F.when(
            (F.size(acc) > 0) & (r["start"] <= F.get(acc, F.size(acc) - 1)["stop"]),
            F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(
                F.get(acc, F.size(acc) - 1)["start"].alias("start"),
                F.greatest(F.get(acc, F.size(acc) - 1)["stop"], r["stop"]).alias("stop")))))
        .otherwise(F.concat(acc, F.array(r))))
    return scratch(ranges.groupBy("doc_id", "crc").agg(spans.alias("spans")), "spans")


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """``docs`` with a column spans (null: nothing to remove); only documents that may have some are shuffled."""
    keyed = docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST_ID)))})
    keyed = keyed.withColumn("_slot", F.xxhash64("_id").bitwiseAND(SLOTS - 1))
    slots = F.broadcast(_slots(spans))
    some = (keyed.join(slots, "_slot", "left_semi").drop("_slot")
            .withColumn("_crc", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))))
    some = some.join(unsent(spans.select(F.col("doc_id").alias("_id"), F.col("crc").alias("_crc"), "spans")),
                     ["_id", "_crc"], "left").drop("_id", "_crc")
    none = keyed.join(slots, "_slot", "left_anti").drop("_slot", "_id").withColumn(
        "spans", F.lit(None).cast(spans.schema["spans"].dataType))
    return some.select(*none.columns).unionByName(none)


@F.pandas_udf(BinaryType())
def cut_bytes(text: pd.Series, spans: pd.Series) -> pd.Series:
    """UTF-8 bytes of a text without its spans; null where the text is null."""
    def cut(t, ranges):
        if t is None:
            return None
        raw, out, at = t.encode(), [], 0
        for r in ranges:
            out.append(raw[at:r["start"]])
            at = r["stop"]
        return b"".join(out) + raw[at:]
    return pd.Series([cut(t, s) for t, s in zip(text, spans)], dtype=object)


def kept_bytes():
    """Column: what is left of ``text`` after ``spans``."""
    has = F.col("spans").isNotNull()
    raw = F.coalesce("text", F.lit("")).cast("binary")
    return F.when(has, cut_bytes(F.when(has, F.col("text")), F.col("spans"))).otherwise(raw)


@F.pandas_udf(StringType())
def cut_text(text: pd.Series, spans: pd.Series) -> pd.Series:
    """A text without its spans; a span gives up parts of characters at its ends, so the rest is UTF-8."""
    def cut(t, ranges):
        if t is None:
            return None
        raw, out, at = t.encode(), [], 0
        for r in ranges:
            lo, hi = r["start"], r["stop"]
            while lo < hi and raw[lo] & 0xC0 == 0x80:
                lo += 1
            while lo < hi < len(raw) and raw[hi] & 0xC0 == 0x80:
                hi -= 1
            out.append(raw[at:lo])
            at = hi
        return (b"".join(out) + raw[at:]).decode()
    return pd.Series([cut(t, s) for t, s in zip(text, spans)], dtype=object)


@others_packed
def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut from text, and n_chars (if there is one) counted anew where cut."""
    cut = with_spans(docs, repeated_spans(docs, length))
    has = F.col("spans").isNotNull()
    text = cut_text(F.when(has, F.col("text")), F.col("spans"))
    out = cut.withColumn("text", F.when(has, text).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(has, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
