"""Token ids by a public tokenizer file, fast where white space separates tokens."""

from __future__ import annotations

import hashlib
import os
import re
from array import array

import numpy as np
import pyarrow as pa

from saltmarsh.llm.worker import cache_of

#: Bytes of chunks and their ids, in each of the two generations that a worker remembers, with what Python adds for each.
REMEMBERED = 32 << 20
EACH = 160
#: Longer chunks, in bytes, aren't remembered.
LONG = 48
#: Texts are taken together up to so many bytes.
TOGETHER = 1 << 18
#: For the tokenizer up to so many, each row counting as EACH_ROW more: the larger, the more often a chunk comes again and is looked up once.
LOT = 1 << 22
EACH_ROW = 64
#: Chunks that aren't known are learned so many at a time.
LEARNED = 1 << 14
#: Longer texts, in bytes, are cut at white space.
CUT = 1 << 20


def version_of(path: str) -> str:
    """SHA-256 of the tokenizer's file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()

#: Letters below are lower-cased and composed alike by any version of Unicode.
LATIN_END = "\u0250"
#: How byte-level vocabularies write bytes: printable Latin-1 as itself, the others from U+0100 on in order.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}

SIGNS = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


#: Bytes of letters beyond ASCII that byte-level vocabularies don't write as themselves.
_MOVED = [(chr(b), chr(sign)) for b, sign in BYTE_SIGNS.items() if b > 127]
BEYOND = re.compile(f"[{LATIN_END}-\U0010ffff]")


def shown_words(chunks: list[bytes]) -> list[str | None]:
    """Chunks of Latin letters only, lower-cased, as the vocabulary writes them; None for others. None holds ASCII white space."""
    out = [c.decode() if c.isalpha() and c.islower() else None for c in chunks]
    odd = [i for i, c in enumerate(chunks) if not c.isascii()]
    if odd:
        words = b" ".join([chunks[i] for i in odd]).decode().lower()
        signs, latin = words.encode().decode("latin-1"), not BEYOND.search(words)
        for byte, sign in _MOVED:
            signs = signs.replace(byte, sign)
        for i, word, shown in zip(odd, words.split(" "), signs.split(" "), strict=True):
            if word.isalpha() and (latin or not BEYOND.search(word)):
                out[i] = shown
    return out


BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def cut_at_blanks(data: bytes, size: int):
    """Parts of ``data`` of ``size`` bytes or a little more: each but the last ends before ASCII white space."""
    at = 0
    while len(data) - at > size and (blank := BLANK.search(data, at + size)):
        yield data[at : blank.start()]
        at = blank.start()
    yield data[at:]


WHITE = b" \t\n\x0b\x0c\r"
BLANKS = bytes(b in WHITE for b in range(256))
#: Kinds of bytes: a lower-case letter of ASCII, a part of a longer character, a sign, anything else.
SMALL, LONGER, SIGN, OTHER = range(4)
KINDS = bytes(SMALL if 97 <= b < 123 else LONGER if b > 127 else SIGN if b in SIGNS else OTHER for b in range(256))


def ended_by_signs(kinds: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of letters, the last of ASCII, and signs after them: their numbers, and where their signs begin. What is before and after are tokens of their own."""
    odd = np.flatnonzero(kinds >= SIGN)
    i = np.flatnonzero((kinds[odd] == SIGN) & (odd > 0) & (kinds[odd - 1] == SMALL))
    at = odd[i]
    k = np.searchsorted(offsets, at, side="right") - 1
    begin, end, others = offsets[k], offsets[k + 1], odd[kinds[odd] == OTHER]
    last = np.minimum(i + end - at, len(odd)) - 1
    found = (at > begin) & ((i == 0) | (odd[i - 1] < begin)) & (odd[last] == end - 1) & (np.searchsorted(others, at) == np.searchsorted(others, end))
    return k[found], at[found]


def distinct_chunks(texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Chunks are what lies between white space, without the signs after a word of letters, which are chunks themselves.

    Returns the distinct ones, the number of each chunk's among them in turn, and how many chunks there are up to each text's end.
    """
    data = b"\n".join([*texts, b""])
    kept = data.translate(None, WHITE)
    blanks = np.flatnonzero(np.frombuffer(data.translate(BLANKS), dtype=bool))
    # where the bytes before each blank end when blanks are left out; nothing new lies between two in a row
    ends = blanks - np.arange(len(blanks))
    text_ends = ends[np.searchsorted(blanks, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1)]
    offsets = np.concatenate(([0], ends[np.diff(ends, prepend=0) > 0]))
    k, at = ended_by_signs(np.frombuffer(kept.translate(KINDS), dtype=np.uint8), offsets)
    offsets = np.insert(offsets, k + 1, at).astype(np.int32)
    every = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
    _, at, bytes_of = every.dictionary.buffers()
    at, held = np.frombuffer(at, dtype=np.int32)[: len(every.dictionary) + 1].tolist(), bytes_of.to_pybytes() if bytes_of else b""
    return [held[a:b] for a, b in zip(at, at[1:], strict=False)], every.indices.to_numpy(), np.searchsorted(offsets, text_ends)


def laid_out(ids: list[bytes], numbers: np.ndarray) -> tuple[bytes, np.ndarray]:
    """``ids[n]`` for each n of ``numbers`` in turn, as one string, and where in it each begins; at last its length."""
    sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
    begins = np.cumsum(sizes) - sizes
    size = sizes[numbers]
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    source = np.arange(total) + np.repeat(begins[numbers] - ends + size, size)
    return np.frombuffer(b"".join(ids), dtype=np.uint32)[source].tobytes(), 4 * np.concatenate(([0], ends))


class ChunkTokenizer:
    """Ids of whole texts, as ``tokenizers`` gives them without added special tokens.

    Only for tokenizers whose normalizer and pre-tokenizer treat white space as a
    separator and drop it (word_bpe_49k does): no token, merge or composed character
    spans ASCII white space, so a text's ids are its chunks' ids in turn. Texts taken
    together are split at once, and each distinct chunk is looked up once. The library
    encodes each chunk it hasn't met; special strings hold no white space and are its
    own business. Case is folded first where that can't show: A-Z alone, in texts
    without special strings and without combining marks (with which it might change
    what NFC composes).
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.library = Tokenizer.from_file(path)
        #: The same model alone, for words that its normalizer and pre-tokenizer pass whole.
        self.words = Tokenizer(self.library.model)
        self.words.pre_tokenizer = WhitespaceSplit()
        vocabulary, suffix = self.library.get_vocab(), getattr(self.library.model, "end_of_word_suffix", None)
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True
        self.young: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}
        self.held = 0  # bytes of the younger generation

    def _remember(self, chunks, ids) -> None:
        before = len(self.young)
        self.young.update(zip(chunks, ids, strict=True))
        self.held += EACH * (len(self.young) - before) + sum(map(len, chunks)) + sum(map(len, ids))

    def _forget(self, chunk: bytes) -> None:
        ids = self.young.pop(chunk, None)
        if ids is not None:
            self.held -= EACH + len(chunk) + len(ids)

    def _fold(self, data: bytes) -> bytes:
        return data.lower() if b"<|" not in data and b"\xcc" not in data and b"\xcd" not in data else data

    def _encode(self, chunks: dict[bytes, str | None]) -> None:
        """Words, given as the vocabulary writes them, go to the model at once, as one text; all else to the whole library."""
        plain = [c for c, shown in chunks.items() if shown is not None]
        others = [c for c, shown in chunks.items() if shown is None]
        shown = [chunks[c] for c in plain]
        if plain:
            ids = array("I", self.words.encode_batch_fast([" ".join(shown)], add_special_tokens=False)[0].ids)
            data, cuts = ids.tobytes(), [0, *(4 * (np.flatnonzero(self.ends[np.asarray(ids)]) + 1)).tolist()]
            if len(cuts) == len(plain) + 1 and cuts[-1] == len(data):
                self._remember(plain, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
            else:
                others += plain
        if others:
            encoded = self.library.encode_batch_fast([c.decode() for c in others], add_special_tokens=False)
            self._remember(others, [array("I", e.ids).tobytes() for e in encoded])

    def _recall(self, chunks) -> list[bytes]:
        """Brings chunks that the older generation has to the younger one; the others are returned."""
        found = self.old.keys() & chunks
        self._remember(found, list(map(self.old.__getitem__, found)))
        return [c for c in chunks if c not in found]

    def _learn(self, unknown: list[bytes]) -> None:
        ended, rest = [], {}
        chunks = self._recall(unknown)
        # signs after a word are a token of their own, or several
        words = [c.rstrip(SIGNS) for c in chunks]
        for c, word, shown in zip(chunks, words, shown_words(words), strict=True):
            if shown is None:
                rest[c] = None
                continue
            rest[word] = shown
            if word != c:
                ended.append((c, word))
                rest[c[len(word) :]] = None
        new = self._recall(rest.keys() - self.young.keys())
        self._encode({c: rest[c] for c in new})
        if ended:
            self._remember([c for c, _ in ended], [self.young[word] + self.young[c[len(word) :]] for c, word in ended])

    def ids(self, texts: list[bytes]) -> list[bytes]:
        """For each UTF-8 text its ids as little-endian unsigned 32-bit integers."""
        out = self._ids([t if len(t) <= CUT else b"" for t in texts])
        for i, t in enumerate(texts):
            if len(t) > CUT:
                out[i] = b"".join(self._ids([part])[0] for part in cut_at_blanks(t, CUT))
        return out

    def _ids(self, texts: list[bytes]) -> list[bytes]:
        chunks, numbers, until = distinct_chunks(list(map(self._fold, texts)))
        found = list(map(self.young.get, chunks))
        missing = [i for i, ids in enumerate(found) if ids is None]
        for at in range(0, len(missing), LEARNED):
            if self.held > REMEMBERED:
                self.old, self.young, self.held = self.young, {}, 0
            part = missing[at : at + LEARNED]
            # a part before may have brought some as words that signs follow
            self._learn([chunks[i] for i in part if chunks[i] not in self.young])
            for i in part:
                found[i] = self.young[chunks[i]]
            for i in part:
                if len(chunks[i]) > LONG:
                    self._forget(chunks[i])
                    self._forget(chunks[i].rstrip(SIGNS))
        data, cuts = laid_out(found, numbers)
        cuts = [0, *cuts[until].tolist()]
        return [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


_loaded: dict[str, ChunkTokenizer] = cache_of({}, "tokens")


def tokenizer(path: str) -> ChunkTokenizer:
    """One for each file and worker process."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]


def in_portions(values, size=TOGETHER):
    """Lists of consecutive (position, UTF-8 bytes) of an Arrow string array, of about ``size`` bytes; null counts as empty."""
    portion, held = [], 0
    for i, v in enumerate(values):
        data = v.as_buffer().to_pybytes() if v.is_valid else b""
        portion.append((i, data))
        held += len(data)
        if held >= size:
            yield portion
            portion, held = [], 0
    if portion:
        yield portion


def in_lots(batches, key: str, text: str):
    """Keys and UTF-8 texts of consecutive rows, whatever their batch, of about LOT bytes; null counts as empty."""
    keys, texts, held = [], [], 0
    for batch in batches:
        for k, v in zip(batch.column(key).to_pylist(), batch.column(text), strict=True):
            data = v.as_buffer().to_pybytes() if v.is_valid else b""
            keys.append(k)
            texts.append(data)
            held += len(data) + EACH_ROW
            if held >= LOT:
                yield keys, texts
                keys, texts, held = [], [], 0
    if keys:
        yield keys, texts
