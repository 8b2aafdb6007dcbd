"""Round trips and exact comparisons of the token operators."""

import random
import shutil
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tunelake.llm import huffman_ids as H
from tunelake.llm import piece_tokens as P

from helpers import empty, odd_documents

WORD_FILE = public_tokenizers.path("word_bpe_49k.json")
PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
LETTERS = list("ab cde  \n\t'strvemldAEIS.,<>|s/▁") + ["é", "é", "中", "\U0001f600", "́", "\x00", "İ", "Σ", "ß",
                                                         "1", "ﬁ", "​", "\xa0", "　", "\x85", "Å"]


def odd_texts(n, seed):
    rng = random.Random(seed)
    return ["", " ", "  ", "\n", "▁", "<s>", "<0x0A>", "<|endoftext|>", "a<|startoftext|>b", "it's", "x" * 3000] + [
        "".join(rng.choice(LETTERS) for _ in range(rng.randint(1, 60))) for _ in range(n)]


def test_words_match_library():
    own, library = H.WordTokenizer(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    texts = odd_texts(4000, 3)
    want = library.encode_batch(texts, add_special_tokens=False)
    for got, w in zip(own.encode(texts), want):
        assert np.frombuffer(got, np.uint32).tolist() == w.ids


def test_code_lengths():
    rng = np.random.default_rng(0)
    for n, bits in ((1, 20), (2, 20), (300, 9), (5000, 13), (5000, 20)):
        counts = np.zeros(n + 5, np.int64)
        counts[:n] = (1.5 ** rng.integers(0, 40, n)).astype(np.int64) + 1
        lengths = H.code_lengths(counts, bits)
        assert lengths.max() <= bits and (lengths[n:] == 0).all() and (lengths[:n] > 0).all()
        kraft = sum(2.0 ** -int(x) for x in lengths[:n])
        assert kraft <= 1 + 1e-12 and (n == 1 or kraft > 1 - 1e-9)
        by = np.argsort(-counts[:n], kind="stable")
        assert (np.diff(lengths[:n][by].astype(int)) >= 0).all() or len(set(counts[:n])) < n


def test_code_lengths_are_huffman_without_limit():
    import heapq
    counts = np.random.default_rng(2).integers(1, 1000, 200)
    heap = [(int(c), i, 0) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    total, k = 0, len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        total += a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], k, 0))
        k += 1
    assert int((H.code_lengths(counts, 30) * counts).sum()) == total


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 5000).clip(max=4000)
    code = H.Code.of(H.code_lengths(np.bincount(ids, minlength=4096)))
    for n in (0, 1, 255, 256, 257, 5000):
        bits, offsets = H.encode_block(ids[:n], code)
        assert (H.decode_block(bits, offsets, n, code.table()) == ids[:n]).all()


def test_store(spark, tmpdir_fresh):
    docs, rows = odd_documents(spark)
    folder = f"{tmpdir_fresh}/store"
    assert H.write_ids(docs, WORD_FILE, folder) == folder
    shutil.move(folder, folder + "2")  # the reader has the files alone
    got = H.read_ids(spark, folder + "2").collect()
    library = Tokenizer.from_file(WORD_FILE)
    want, start = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((d, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(r.ids)) for r in got) == [
        (s, d, n, c) for d, s, n, c in want]
    assert H.read_ids(spark, H.write_ids(empty(spark), WORD_FILE)).count() == 0


def test_large_ids(spark):
    """Ids beyond 16 bits have a place in the code."""
    docs, rows = odd_documents(spark)
    end = 1 << 17
    got = H.read_ids(spark, H.write_ids(docs, WORD_FILE, end_id=end)).collect()
    assert len(got) == len(rows) and all(np.frombuffer(r.ids, "<u4")[-1] == end for r in got)
    assert H.vocabulary_size(WORD_FILE) == max(Tokenizer.from_file(WORD_FILE).get_vocab().values()) + 1


def test_pieces_match_library():
    model, library = P.PieceModel(PIECE_FILE), sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    for t in odd_texts(4000, 5):
        want = library.encode(t)
        assert model.encode(t).tolist() == want
        assert model.decode(want + [2]) == library.decode(want + [2])
    rng = random.Random(9)
    for _ in range(2000):
        ids = [rng.choice([rng.randrange(3, 259), rng.randrange(259, 32000)]) for _ in range(rng.randint(0, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_piece_frames(spark):
    docs, rows = odd_documents(spark)
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_FILE)
    ids = P.encode(docs, PIECE_FILE)
    got = ids.select("doc_id", "ids", P.decode(PIECE_FILE)("ids").alias("text")).collect()
    want = [(d, library.encode(t or "") + [2]) for d, t in rows]
    key = repr
    assert sorted(((r.doc_id, list(r.ids), r.text) for r in got), key=key) == sorted(
        ((d, i, library.decode(i)) for d, i in want), key=key)
    assert P.encode(empty(spark), PIECE_FILE).select(F.size("ids")).count() == 0


def test_word_store_keeps_its_later_half(monkeypatch):
    """The store outlives a task and an overflow, stays bounded, and the ids are the library's."""
    import random

    import numpy as np
    import public_tokenizers

    from helpers import text
    from tunelake.llm import huffman_ids

    monkeypatch.setattr(huffman_ids, "CACHE_WORDS", 60)
    store = huffman_ids.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(3)
    for _ in range(6):
        texts = [text(rng, 30), "", "Zwei W\u00f6rter!?"]
        got = [np.frombuffer(x, np.uint32).tolist() for x in store.encode(texts)]
        assert got == [store.library.encode(t, add_special_tokens=False).ids for t in texts]
    before = list(store.cache)
    assert 60 < len(before) < 200
    store.encode(["one more"])
    assert before[-1] in store.cache and before[0] not in store.cache


def test_words_are_met_without_their_marks():
    """A word is learned once, whatever marks and capitals it has, and one of small letters without the full pipeline."""
    store, library = H.WordTokenizer(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    text = "ended ended, Ended. ended!! (ended) ended$$$ ended*** Été été, ÉTÉß&&& où it's"
    assert np.frombuffer(store.encode([text])[0], np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    met = {w.decode() for w in store.cache}
    assert {w for w in met if w.strip("()!.,$*&'s")} == {"(ended", "ended", "été", "étéß", "où", "it"}

    class Counted:
        words = []

        def encode_batch_fast(self, texts, **kw):
            self.words += texts
            return library.encode_batch_fast(texts, **kw)

    store.library = Counted()
    text = "Über straße, garçon. à la Øl!"
    assert np.frombuffer(store.encode([text])[0], np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids
    assert not any(c.isalpha() for w in Counted.words for c in w)


def test_combining_marks_match_library():
    """Lowering comes after composing: a capital has no composed form where its small letter has one."""
    store, library = H.WordTokenizer(WORD_FILE), Tokenizer.from_file(WORD_FILE)
    rng = random.Random(11)
    texts = ["H̱a b", "T̈.", "J̌ é", "W̊, y", "Aʾ"] + [
        "".join(rng.choice("abcHTJ Éé×÷ÿß'st.,<>|!-̱́̈̌") for _ in range(30))
        for _ in range(500)]
    for got, w in zip(store.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, np.uint32).tolist() == w.ids


def test_special_tokens_stay_whole(tmp_path):
    """A text is not parted before a mark that follows a letter in a special token."""
    import json

    with open(WORD_FILE) as f:
        model = json.load(f)
    model["added_tokens"].append({**model["added_tokens"][0], "id": 49408, "content": "<s>"})
    path = tmp_path / "with_s.json"
    path.write_text(json.dumps(model))
    own, library = H.WordTokenizer(str(path)), Tokenizer.from_file(str(path))
    texts = ["<s>", "a<s>b, <s>!", "it's <s>x<|endoftext|>."]
    for got, w in zip(own.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(got, np.uint32).tolist() == w.ids and 49408 in w.ids
    assert np.flatnonzero(H._MARKS & ~H.WordTokenizer(WORD_FILE).marks).tolist() == [ord("|")]
