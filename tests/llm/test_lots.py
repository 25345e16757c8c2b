"""Texts taken together: what is looked up, and that nothing is lost or told apart wrongly."""

import random
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from saltmarsh.llm import tokens
from saltmarsh.llm.packing import _cutter
from saltmarsh.llm.token_counts import _encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


class Counting(dict):
    lookups = 0

    def get(self, key):
        self.lookups += 1
        return super().get(key)


def test_each_distinct_chunk_is_looked_up_once():
    known = tokens.ChunkTokenizer(PATH)
    known.young = Counting()
    known.ids([b"Some words, which come again: words, some.\n"] * 500)
    # some words which come again , : .
    assert known.young.lookups == 8


def test_a_lot_goes_on_over_batches(monkeypatch):
    calls, encode = [], tokens.ChunkTokenizer.ids
    monkeypatch.setattr(tokens.ChunkTokenizer, "ids", lambda self, texts: calls.append(len(texts)) or encode(self, texts))
    batches = [pa.RecordBatch.from_arrays([pa.array([i, None]), pa.array([f"word {i}", None], pa.string())], ["_id", "_text"]) for i in range(20)]
    rows = [r for b in _cutter(PATH, 2, 1)(iter(batches)) for r in b.to_pylist()]
    assert calls == [40]
    want = []
    for i in range(20):
        ids = [*tokens.tokenizer(PATH).library.encode(f"word {i}", add_special_tokens=False).ids, 1]
        for doc, whole in ((i, ids), (None, [1])):
            parts = [whole[k : k + 2] for k in range(0, len(whole), 2)]
            want += [{"doc_id": doc, "piece": k, "start": 2 * k, "length": len(p), "ids_crc32": zlib.crc32(array("I", p).tobytes())} for k, p in enumerate(parts)]
    assert rows == want
    monkeypatch.setattr(tokens, "LOT", 180)
    assert [r for b in _cutter(PATH, 2, 1)(iter(batches)) for r in b.to_pylist()] == want
    assert set(calls[1:-1]) == {3}
    batches = [pa.RecordBatch.from_arrays([pa.array([b"%d" % i], pa.binary()), pa.array([f"word {i}"])], ["content_digest", "_content"]) for i in range(20)]
    counted = [(r["content_digest"], r["n_tokens"]) for b in _encoder(PATH)(iter(batches)) for r in b.to_pylist()]
    assert counted == [(b"%d" % i, 2 + (i > 9)) for i in range(20)]


@pytest.mark.parametrize("learned", [3, 1 << 14])
def test_odd_chunks_have_the_librarys_ids(monkeypatch, learned):
    monkeypatch.setattr(tokens, "LEARNED", learned)
    monkeypatch.setattr(tokens, "REMEMBERED", 2000)
    rng, known = random.Random(5), tokens.ChunkTokenizer(PATH)
    parts = ["a", "b", "word", "é", "É", "Q", "7", "日", "€", ".", ",", "'", "'s", "!", "<|", "|>", "endoftext", "<|endoftext|>", "_", "=", " ", "  ", "\n", "\t\r", "\x0b", "\x1c", "\x85", "\xa0", "̸", "́", "\x00"]
    for _ in range(150):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(rng.randint(0, 9))]
        want = [array("I", known.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        assert known.ids([t.encode() for t in texts]) == want
        assert known.held == sum(tokens.EACH + len(c) + len(i) for c, i in known.young.items())


def test_a_long_text_leaves_the_others_together(monkeypatch):
    monkeypatch.setattr(tokens, "CUT", 50)
    known, calls = tokens.ChunkTokenizer(PATH), []
    texts = ["a few words"] * 9 + ["many more of them " * 9, "the end"]
    want = [array("I", known.library.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
    once = known._ids
    monkeypatch.setattr(known, "_ids", lambda part: calls.append(len(part)) or once(part))
    assert known.ids([t.encode() for t in texts]) == want
    assert calls[0] == 11 and set(calls[1:]) == {1} and len(calls) < 6


def test_distinct_chunks_are_those_of_split():
    rng = random.Random(8)
    for _ in range(200):
        texts = ["".join(rng.choices("abé7A.,' \n\t\x0b", k=rng.randint(0, 30))).encode() for _ in range(rng.randint(0, 6))]
        chunks, numbers, until = tokens.distinct_chunks(texts)
        assert len(set(chunks)) == len(chunks)
        got = [[chunks[n] for n in numbers[a:b]] for a, b in zip([0, *until], until, strict=False)]
        want = []
        for t in texts:
            want.append([])
            for c in t.split():
                word = c.rstrip(tokens.SIGNS)
                plain = word and word != c and 97 <= word[-1] < 123 and all(97 <= b < 123 or b > 127 for b in word)
                want[-1] += [word, c[len(word) :]] if plain else [c]
        assert got == want


def test_ids_laid_out():
    data, begins = tokens.laid_out([array("I", x).tobytes() for x in ([1, 2], [], [7])], np.array([2, 0, 1, 0]))
    assert list(array("I", data)) == [7, 1, 2, 1, 2] and begins.tolist() == [0, 4, 12, 12, 20]
    assert tokens.laid_out([], np.array([], dtype=np.int64))[0] == b""
