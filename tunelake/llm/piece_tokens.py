"""SentencePiece BPE ids by a merge-type prefix table.

For every prefix of a text there is exactly one token that can end its
encoding.  The table keeps that token: an automaton lists the tokens ending at
each position, and the one that is pair-compatible with the token stored where
it starts is the right one.  Ids are then read backwards from the end.  This
is linear in the text and needs no merge queue.

Two tokens are compatible if no merge across their border would come earlier
than the merges that build them; it is enough to walk the right edge of the
left token's merge tree and the left edge of the right one's.

Cases: null text counts as empty; the empty text has the end id alone;
characters outside the vocabulary become byte ids and border all merges; texts
of any length are read whole; repeated rows are encoded one by one; an empty
table gives an empty table; extra columns are ignored.  Ids outside the
vocabulary make the decoder fail; bytes that are no UTF-8 decode to U+FFFD,
one for each byte.
"""

from __future__ import annotations

import re
from array import array

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tunelake.llm.common import give_back

SPACE = "▁"
END_ID = 2
# Words kept encoded in each worker: the newest ones, and those met again since the store was last full.
CACHE_WORDS = 250_000
KNOWN_PAIRS = 300_000
CACHE_CHARS = 48
NEVER = 1 << 60


class PieceModel:
    """Vocabulary of a sentencepiece BPE model, read through its library."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ids = {sp.id_to_piece(i): i for i in range(n)
               if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.byte_ids = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.ids = ids
        # Merge order: best score first.
        self.rank = {i: r for r, i in enumerate(sorted(ids.values(), key=lambda i: (-sp.get_score(i), i)))}
        for piece, i in ids.items():
            if len(piece) == 1:
                self.rank[i] = -1
        self.bytes_of = [b""] * n
        for piece, i in ids.items():
            self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes_of[i] = bytes([b])
        self.single = {i for i in self.byte_ids.values()}
        self._build()
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _build(self) -> None:
        ids, rank = self.ids, self.rank
        # Pairs of tokens that merge, and the pair each token is really made of.
        self.pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    self.pairs[a, b] = i
        made = {}
        for piece, i in ids.items():
            if len(piece) > 1:
                made[i] = self._last_merge(piece)
        self.made = {i: p for i, p in made.items() if p}
        usable = {p: i for p, i in ids.items() if len(p) == 1 or i in self.made}
        for i, (a, b) in self.made.items():
            if rank[a] >= rank[i] or rank[b] >= rank[i]:
                raise ValueError(f"token {i} comes before its parts: not a trained BPE vocabulary")
        self.right_edge = {i: self._edge(i, 1) for i in usable.values()}
        self.left_edge = {i: self._edge(i, 0) for i in usable.values()}
        self.length = {i: len(p) for p, i in usable.items()}
        self.automaton = ahocorasick.Automaton()
        for piece, i in usable.items():
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.compatible: dict[int, dict[int, bool]] = {}  # left token -> right token -> may they stand side by side?
        self.n_known = 0
        # Space marks stand at the front of tokens only: then a text falls
        # apart into words before them; and around line ends if no token has one.
        apart = all(SPACE not in p.lstrip(SPACE) for p in usable)
        lines = all("\n" not in p for p in usable)
        self.words = re.compile(rf"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+" if apart and lines else
                                rf"{SPACE}*[^{SPACE}]+|{SPACE}+" if apart else r"(?s:.+)")

    def _last_merge(self, piece: str):
        """The two tokens whose merge completes ``piece``, or None if it never arises."""
        parts = [self.ids.get(c) for c in piece]
        last = None
        while len(parts) > 1:
            best = min(((self.rank[z], k) for k in range(len(parts) - 1)
                        if (z := self.pairs.get((parts[k], parts[k + 1]))) is not None), default=None)
            if best is None:
                return None
            k = best[1]
            last = parts[k], parts[k + 1]
            parts[k:k + 2] = [self.pairs[last]]
        return last if parts[0] == self.ids[piece] else None

    def _edge(self, i: int, side: int) -> list[tuple[int, int]]:
        """(token, rank of the merge after it) along one edge of the tree, leaf first."""
        chain = [i]
        while chain[-1] in self.made:
            chain.append(self.made[chain[-1]][side])
        chain.reverse()
        return [(t, self.rank[up]) for t, up in zip(chain, chain[1:])] + [(i, NEVER)]

    def _fits(self, a: int, b: int) -> bool:
        left, right, i, j = self.right_edge[a], self.left_edge[b], 0, 0
        while True:
            (x, next_x), (y, next_y) = left[i], right[j]
            across = self.pairs.get((x, y))
            # Equal ranks merge from left to right.
            if across is not None and (r := self.rank[across]) < next_x and r <= next_y:
                return False
            if next_x == next_y == NEVER:
                return True
            if next_x <= next_y:
                i += 1
            else:
                j += 1

    def encode_word(self, word: str) -> list[int]:
        n = len(word)
        last = [-1] * n  # -1: none yet, or a character outside the vocabulary
        known = self.compatible
        if self.n_known > KNOWN_PAIRS:
            known.clear()
            self.n_known = 0
        for end, (t, size) in self.automaton.iter(word):
            if last[end] < 0:
                if size > end or (p := last[end - size]) < 0:
                    last[end] = t
                    continue
                row = known.get(p)
                if row is None:
                    row = known[p] = {}
                fits = row.get(t)
                if fits is None:
                    fits = row[t] = self._fits(p, t)
                    self.n_known += 1
                if fits:
                    last[end] = t
        out, i, length = [], n - 1, self.length
        while i >= 0:
            t = last[i]
            if t < 0:
                out += [self.byte_ids[b] for b in reversed(word[i].encode())]
                i -= 1
            else:
                out.append(t)
                i -= length[t]
        out.reverse()
        return out

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text, without an end id."""
        if not text:
            return np.zeros(0, np.int32)
        words = self.words.findall(SPACE + text.replace(" ", SPACE))
        got = list(map(self.cache.get, words))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    got[i] = self._word(words[i])
        return np.frombuffer(b"".join(got), np.int32)

    def _word(self, word: str) -> bytes:
        """Ids of a word that the newer store lacks (or got a moment ago)."""
        ids = self.cache.get(word)
        if ids is not None:
            return ids
        ids = self.older.get(word)
        if ids is None:
            ids = array("i", self.encode_word(word)).tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_WORDS:
                self.older, self.cache = self.cache, {}
            self.cache[word] = ids
        return ids

    def forget(self) -> None:
        """Empty the stores: a worker that waits for its next task holds the tables alone."""
        self.cache, self.older, self.compatible, self.n_known = {}, {}, {}, 0

    def decode(self, ids) -> str:
        """Text of ids; control ids have none.  The mark put before a text goes."""
        table = self.bytes_of
        raw = b"".join([table[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._decode_loose(ids)
        first = next((i for i in ids if table[i]), None)
        return text[1:] if first is not None and first not in self.single and text.startswith(" ") else text

    def _decode_loose(self, ids) -> str:
        out, run = [], b""
        for i in [*ids, END_ID]:
            if i in self.single:
                run += self.bytes_of[i]
                continue
            while run:
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[:size].decode())
                        run = run[size:]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    run = run[1:]
            out.append(self.bytes_of[i].decode())
        return "".join(out)


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """One model for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


# Rows that become Python objects at once, whatever the session's Arrow batch is.
SLICE = 256
_IDS = pa.list_(pa.int32())


def _encoded(model: PieceModel, texts: pa.Array, end: bytes) -> pa.ListArray:
    raw = [model.encode(t or "").tobytes() + end for t in texts.to_pylist()]
    sizes = np.asarray([len(r) // 4 for r in raw], np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes, dtype=np.int32))), pa.int32()),
                                    pa.array(np.frombuffer(b"".join(raw), np.int32), pa.int32()))


def _decoded(model: PieceModel, ids: pa.Array) -> pa.Array:
    return pa.array([None if x is None else model.decode(x) for x in ids.to_pylist()], pa.string())


def _sliced(model_path: str, end_id: int | None, with_text: bool):
    end = np.asarray([] if end_id is None else [end_id], np.int32).tobytes()

    def run(batches):
        give_back()
        model = load(model_path)
        for b in batches:
            for at in range(0, b.num_rows, SLICE):
                part = b.slice(at, SLICE)
                ids = _encoded(model, part.column(1), end)
                columns, names = [part.column(0), ids], ["doc_id", "ids"]
                if with_text:
                    columns, names = [*columns, _decoded(model, ids)], [*names, "text"]
                yield pa.RecordBatch.from_arrays(columns, names=names)
        model.forget()
    return run


def _mapped(docs: DataFrame, model_path: str, text: str, end_id: int | None, with_text: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + (", text string" if with_text else "")
    rows = docs.select(F.col("doc_id").alias("a"), F.col(text).alias("b"))
    return rows.mapInArrow(_sliced(model_path, end_id, with_text), schema)


def encode(docs: DataFrame, model_path: str, text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids array<int>) of every row of ``docs``; row-local, no shuffle."""
    return _mapped(docs, model_path, text, end_id, False)


def encode_and_decode(docs: DataFrame, model_path: str, text: str = "text", end_id: int | None = END_ID) -> DataFrame:
    """(doc_id, ids array<int>, text): the ids of every row and the text that they decode to, in one pass."""
    return _mapped(docs, model_path, text, end_id, True)


def decode(model_path: str):
    """Column function: array of ids to text."""
    @F.arrow_udf(StringType())
    def decoded(ids: pa.Array) -> pa.Array:
        model = load(model_path)
        return pa.concat_arrays([pa.array([], pa.string())] + [_decoded(model, ids.slice(at, SLICE).cast(_IDS))
                                                               for at in range(0, len(ids), SLICE)])
    return decoded
