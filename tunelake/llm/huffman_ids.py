"""Token ids as canonical, length-limited Huffman blocks.

Writing: documents are range-partitioned by id and sorted, encoded with the
tokenizers library and kept as packed id blocks; one aggregation counts ids
over all blocks; package-merge gives the best code with at most ``MAX_BITS``
bits; each block then becomes a row of a Parquet table: its bits, and the bit
offset of every ``STRIDE``-th id.  Blocks are independent, so a reader can
take any of them, and a lost task rewrites only its own.

The files are complete: ``blocks`` holds the bits, ``code`` the code lengths and
the stride.  ``read_ids`` needs nothing else.

Reading: the offsets cut a block into segments that are decoded side by side,
one table lookup for each id.

Cases: a null text counts as empty; an empty text has the end id alone; long
texts run over block borders as they need (a document never leaves its block);
documents with equal ids are ordered by text; null ids come first; an empty
table gives an empty store; extra columns are ignored.
"""

from __future__ import annotations

import codecs
import os
import re
import unicodedata
from dataclasses import dataclass
from itertools import islice, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tunelake.llm.common import deltas, in_slices, pack, release, scratch, undeltas, unpack
from tunelake.session import work_folder

END_ID = 2
MAX_BITS = 20
STRIDE = 256
BLOCK_IDS = 1 << 20
CACHE_WORDS = 500_000
SLICE = 512  # texts that are encoded together


# --- tokenizer -----------------------------------------------------------------

_MARKS = np.zeros(256, bool)
_MARKS[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True
# Small letters up to U+00FF, in UTF-8.
_SMALL = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
# The characters that stand for bytes in byte-level vocabularies; a space stays one and parts words.
_SHOWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
_HIDDEN = {b: chr(256 + i) for i, b in enumerate(sorted({*range(256)} - {*_SHOWN}))}
_BYTE_CHARS = "".join(" " if b == 32 else _HIDDEN.get(b, chr(b)) for b in range(256))
_COMBINING = re.compile("[\u0300-\u036f]")


def _byte_chars(raw: bytes) -> str:
    return codecs.charmap_decode(raw, "strict", _BYTE_CHARS)[0]


class WordTokenizer:
    """``Tokenizer.from_file(path).encode(text, add_special_tokens=False)``, word by word.

    The tokenizer drops white space and never joins across it, so a text's ids
    are the ids of its words one after another.  Each worker keeps the ids of
    the words it has met, from task to task and at most CACHE_WORDS and a slice's; new ones are encoded together in one library call.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task on each core
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        # Words of small letters need no normalising and no splitting: the same model without these steps.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer, self.plain.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        beyond = " ".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
        self.byte_level = (self.plain.encode(_byte_chars(beyond.encode()), add_special_tokens=False).ids
                           == self.library.encode(beyond, add_special_tokens=False).ids)
        self.ends_word = np.zeros(self.library.get_vocab_size(), bool)
        for token, i in self.library.get_vocab().items():
            self.ends_word[i] = token.endswith("</w>")
        # Marks that follow a letter in no special token: a text may be parted before them.
        self.marks = _MARKS.copy()
        for token in self.library.get_added_tokens_decoder().values():
            self.marks[[ord(b) for a, b in pairwise(token.content) if a.isalpha() and b.isascii()]] = False
        self.cache: dict[bytes, bytes] = {}  # ids of a word, by its UTF-8 bytes

    def _learn(self, words: list[bytes]) -> None:
        """Ids of new words.  Words of letters only are encoded as one text and cut at word ends."""
        plain, letters, alone = [], [], []
        for w in words:
            (plain if w.isalpha() or self.byte_level and _SMALL.fullmatch(w)
             else letters if not w.isascii() and w.decode().isalpha() else alone).append(w)
        for library, written, some in ((self.plain, _byte_chars, plain), (self.library, bytes.decode, letters)):
            groups = [some[i:i + 256] for i in range(0, len(some), 256)]
            for group, enc in zip(groups, library.encode_batch_fast([written(b" ".join(g)) for g in groups],
                                                                    add_special_tokens=False)):
                ids = np.asarray(enc.ids, np.uint32)
                cuts = np.flatnonzero(self.ends_word[ids]) + 1
                if len(cuts) != len(group):
                    alone += group
                    continue
                raw, at = ids.tobytes(), 0
                for w, cut in zip(group, (cuts * 4).tolist()):
                    self.cache[w] = raw[at:cut]
                    at = cut
        for w, enc in zip(alone, self.library.encode_batch_fast([w.decode() for w in alone], add_special_tokens=False)):
            self.cache[w] = np.asarray(enc.ids, np.uint32).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        by_words = [_by_words(t) for t in texts]
        # Split at ASCII white space and before marks; what the tokenizer lowers beyond U+00FF is left to it.
        lists = pc.ascii_split_whitespace(_marks_apart(pc.ascii_lower(
            pa.array([t if ok else "" for t, ok in zip(texts, by_words)], pa.large_string())), self.marks))
        words = lists.flatten().dictionary_encode()
        index = words.indices.to_numpy()
        ids = self._ids_of(_as_bytes(words.dictionary))
        # The ids of the distinct words one after another, and from them those of every word.
        size_of = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, start = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size_of) - size_of
        size = size_of[index]
        ends = np.cumsum(size)
        raw = flat[np.arange(size.sum()) + np.repeat(start[index] - ends + size, size)].tobytes()
        word_ends = np.cumsum(pc.list_value_length(lists).to_numpy())
        cuts = (4 * np.concatenate(([0], ends))[np.concatenate(([0], word_ends))]).tolist()
        whole = iter(self.library.encode_batch_fast([t for t, ok in zip(texts, by_words) if not ok],
                                                    add_special_tokens=False))
        return [raw[lo:hi] if ok else np.asarray(next(whole).ids, np.uint32).tobytes()
                for lo, hi, ok in zip(cuts, cuts[1:], by_words)]

    def _ids_of(self, words: list[bytes]) -> list[bytes]:
        """Ids of distinct words, from the store or the library."""
        if len(self.cache) > CACHE_WORDS:  # the later half stays
            self.cache = dict(islice(self.cache.items(), CACHE_WORDS // 2, None))
        cache = self.cache
        cache[b""] = b""
        ids = list(map(cache.get, words))
        new = [w for w, i in zip(words, ids) if i is None]
        if new:
            self._learn(new)
            ids = [cache[w] if i is None else i for w, i in zip(words, ids)]
        return ids


def _marks_apart(lowered: pa.Array, is_mark: np.ndarray) -> pa.Array:
    """Texts with the capitals up to U+00FF lowered and a space between a letter and a mark that follows.

    The tokenizer always parts there, so no id changes, and a word is the same one with and without its marks.
    """
    _, offsets, data = lowered.buffers()
    offsets = np.frombuffer(offsets, np.int64)[lowered.offset:lowered.offset + len(lowered) + 1]
    if not len(lowered) or not offsets[-1]:
        return lowered
    raw = np.frombuffer(data, np.uint8, offsets[-1]).copy()
    # U+00C0 to U+00FF: 0xC3 and a second byte; neither U+00D7 nor U+00F7 is a letter.
    second = np.flatnonzero(raw == 0xC3) + 1
    capital = second[(raw[second] < 0x9F) & (raw[second] != 0x97)]
    raw[capital] += 0x20
    marks = np.flatnonzero(is_mark[raw])
    marks = marks[marks > 0]
    last, lead = raw[marks - 1], raw[np.maximum(marks - 2, 0)]
    letter = (last >= 0x61) & (last <= 0x7A) | (lead == 0xC3) & (last != 0x97) & (last != 0xB7)
    cuts = marks[letter]
    return pa.Array.from_buffers(lowered.type, len(lowered), [
        None, pa.py_buffer(offsets + np.searchsorted(cuts, offsets)), pa.py_buffer(np.insert(raw, cuts, 0x20))])


def _as_bytes(strings: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each string."""
    _, offsets, data = strings.buffers()
    raw = data.to_pybytes() if data else b""
    ends = np.frombuffer(offsets, np.int64)[strings.offset:strings.offset + len(strings) + 1].tolist()
    return [raw[lo:hi] for lo, hi in zip(ends, ends[1:])]


def _by_words(text: str) -> bool:
    """Texts that normalising makes longer, or that lowering first would change, are left to the library as a whole."""
    return text.isascii() or ("\u0130" not in text and unicodedata.is_normalized("NFC", text)
                              and not _COMBINING.search(text))


_LOADED: dict[str, WordTokenizer] = {}


def load(path: str) -> WordTokenizer:
    if path not in _LOADED:
        _LOADED[path] = WordTokenizer(path)
    return _LOADED[path]


# --- code ----------------------------------------------------------------------

def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Lengths (0: unused) of an optimal code of at most ``max_bits`` bits: package-merge."""
    used = np.flatnonzero(counts)
    n = len(used)
    out = np.zeros(len(counts), np.uint8)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} ids don't fit in codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    row, leaf_rows = leaves, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        pairs = row[:len(row) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([leaves, pairs])
        by = np.argsort(both, kind="stable")
        row = both[by]
        leaf_rows.append(by < n)
    lengths, take = np.zeros(n, np.uint8), 2 * n - 2
    for is_leaf in reversed(leaf_rows):
        k = int(is_leaf[:take].sum())
        lengths[:k] += 1
        take = 2 * (take - k)
    out[order] = lengths
    return out


@dataclass
class Code:
    """Canonical code: words of equal length count up with the id, shorter ones first."""
    lengths: np.ndarray
    words: np.ndarray

    @classmethod
    def of(cls, lengths: np.ndarray) -> Code:
        words, word, at = np.zeros(len(lengths), np.uint64), 0, 0
        for i in np.lexsort((np.arange(len(lengths)), lengths)):
            if lengths[i]:
                word <<= int(lengths[i]) - at
                at = int(lengths[i])
                words[i] = word
                word += 1
        return cls(lengths, words)

    def table(self) -> tuple[int, np.ndarray, np.ndarray]:
        """Bits to look at, and the id and length for each of their values."""
        bits = max(1, int(self.lengths.max(initial=1)))
        order = np.lexsort((np.arange(len(self.lengths)), self.lengths))
        order = order[self.lengths[order] > 0]
        spans = (1 << (bits - self.lengths[order].astype(np.int64)))
        ids, lens = np.repeat(order, spans), np.repeat(self.lengths[order], spans)
        pad = (1 << bits) - len(ids)
        return bits, np.pad(ids, (0, pad)).astype(np.uint32), np.pad(lens, (0, pad)).astype(np.int64)


def encode_block(ids: np.ndarray, code: Code, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """Bits (big-endian) of the ids and the offset of every ``stride``-th id."""
    size = code.lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    start = end - size
    total = int(end[-1]) if len(end) else 0
    # Each code falls into one or two 32-bit words; codes in a word share no bit.
    room = 64 - (start & 31) - size
    both = code.words[ids] << room.astype(np.uint64)
    words = np.zeros(total // 32 + 3, np.uint64)
    at = start >> 5
    if len(ids):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        words[at[first]] += np.add.reduceat(both >> np.uint64(32), first)
        words[at[first] + 1] += np.add.reduceat(both & np.uint64(0xFFFFFFFF), first)
    return words.astype(">u4").tobytes()[:(total + 7) // 8], start[::stride].astype(np.uint32)


def decode_block(bits: bytes, offsets: np.ndarray, n: int, table, stride: int = STRIDE) -> np.ndarray:
    """Ids of a block: all its segments go forward together, one id at a time."""
    width, ids_of, size_of = table
    raw = np.frombuffer(bits + bytes(8), np.uint8).astype(np.uint32)
    # 32 bits from each byte on.
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    pos, out = offsets.astype(np.int64), np.zeros((len(offsets), stride), np.uint32)
    shift, mask = 32 - width, (1 << width) - 1
    last = len(offsets) - 1
    for k in range(min(stride, n)):
        if last >= 0 and last * stride + k >= n:  # the last segment is shorter
            pos, last = pos[:last], -1
            if not len(pos):
                break
        peek = (window[pos >> 3] >> (shift - (pos & 7))) & mask
        out[:len(pos), k] = ids_of[peek]
        pos = pos + size_of[peek]
    return out.reshape(-1)[:n]


# --- store -----------------------------------------------------------------------

_BLOCKS = "part int, seq int, n_docs int, n_ids long, docs binary, bits binary, offsets binary"
_CODE = "lengths binary, stride int, end_id int"


def _id_blocks(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Packed ids in ascending order of doc_id, many documents to a row."""
    def run(batches):
        part, seq, end = TaskContext.get().partitionId(), 0, np.asarray([end_id], np.uint32).tobytes()
        tokenizer, ids, docs_in, held = load(path), [], [], 0

        def row():
            sizes = np.asarray([len(x) // 4 for x in ids], np.uint32)
            known = np.asarray([d[1] for d in docs_in], bool)
            keys = np.asarray([d[0] for d in docs_in], np.int64)
            return pd.DataFrame({"part": [part], "seq": [seq], "n_docs": [len(ids)], "n_ids": [int(sizes.sum())],
                                 "docs": [pack(deltas(keys), known, sizes)],
                                 "ids": [pack(np.frombuffer(b"".join(ids), np.uint32))]})

        for b in batches:
            for key, raw in zip(zip(b["doc_id"].tolist(), b["known"].tolist()), tokenizer.encode(b["text"].tolist())):
                ids.append(raw + end)
                docs_in.append(key)
                held += len(raw) // 4 + 1
                if held >= BLOCK_IDS:
                    yield row()
                    ids, docs_in, held, seq = [], [], 0, seq + 1
        if ids:
            yield row()

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
               .select(F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), "text"))
    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_ids", pa.int64()),
                        ("docs", pa.binary()), ("ids", pa.binary())])
    return ordered.mapInArrow(in_slices(run, schema, SLICE),
                              "part int, seq int, n_docs int, n_ids long, docs binary, ids binary")


def vocabulary_size(tokenizer_path: str) -> int:
    """One more than the largest id of the tokenizer."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(tokenizer_path).get_vocab().values(), default=0) + 1


def write_ids(docs: DataFrame, tokenizer_path: str, path: str | None = None, end_id: int = END_ID) -> str:
    """Encode, count, code and write ``docs`` (doc_id, text) to the folder ``path``; the folder.

    Without a path it is one in the shared folder that is deleted when the driver exits.
    """
    spark = docs.sparkSession
    path = path or work_folder(spark, "llm-ids")
    vocab = max(vocabulary_size(tokenizer_path), end_id + 1)
    raw = scratch(_id_blocks(docs, tokenizer_path, end_id), "ids")

    def counted(batches):
        total = np.zeros(vocab, np.int64)
        for b in batches:
            for blob in b["ids"]:
                total += np.bincount(unpack(blob)[0], minlength=vocab)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"id": used, "n": total[used]})

    # One row for each id of the vocabulary: bounded by it.
    sums = raw.select("ids").mapInPandas(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(vocab, np.int64)
    for r in sums:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)

    def coded(batches):
        code = Code.of(lengths)
        for b in batches:
            out = [encode_block(unpack(x)[0], code) for x in b["ids"]]
            yield pd.DataFrame({"part": b["part"], "seq": b["seq"], "n_docs": b["n_docs"], "n_ids": b["n_ids"],
                                "docs": b["docs"], "bits": [x[0] for x in out],
                                "offsets": [pack(deltas(x[1])) for x in out]})

    raw.mapInPandas(coded, _BLOCKS).write.parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(pack(lengths)), STRIDE, end_id)], _CODE).coalesce(1).write.parquet(f"{path}/code")
    release(raw)
    return path


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document of the folder; ids: binary, unsigned 32-bit little-endian."""
    blocks = spark.read.schema(_BLOCKS).parquet(f"{path}/blocks")
    code = spark.read.schema(_CODE).parquet(f"{path}/code").first()  # one row
    lengths, stride = unpack(code["lengths"])[0], code["stride"]
    # Ids before each part: one number for each written part.
    totals = blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()
    before, sums = 0, []
    for r in totals:
        sums.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(sums, "part int, _before long")
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = (blocks.select("part", "seq", "n_ids").withColumn("_in", F.coalesce(F.sum("n_ids").over(within), F.lit(0)))
          .join(F.broadcast(starts), "part")
          .select("part", "seq", (F.col("_before") + F.col("_in")).alias("start")))

    def decoded(batches):
        table = Code.of(lengths).table()
        for b in batches:
            for docs, bits, offsets, n, start in zip(b["docs"], b["bits"], b["offsets"], b["n_ids"], b["start"]):
                keys, known, sizes = unpack(docs)
                ids = decode_block(bits, undeltas(unpack(offsets)[0]), int(n), table, stride)
                ends = np.cumsum(sizes, dtype=np.int64)
                raw = ids.astype("<u4").tobytes()
                doc_ids = pd.array(undeltas(keys), dtype="Int64")
                doc_ids[~known] = pd.NA
                yield pd.DataFrame({
                    "doc_id": doc_ids,
                    "start": start + ends - sizes, "n_tokens": sizes.astype(np.int64),
                    "ids": [raw[4 * (e - s):4 * e] for e, s in zip(ends.tolist(), sizes.tolist())]})

    return (blocks.join(at, ["part", "seq"])
            .select("docs", "bits", "offsets", "n_ids", "start")
            .mapInPandas(decoded, "doc_id long, start long, n_tokens long, ids binary"))
