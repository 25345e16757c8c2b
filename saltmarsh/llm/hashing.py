"""Hashes of words and shingles of many texts at once, on whole byte arrays."""

from __future__ import annotations

import numpy as np

from saltmarsh.llm.worker import cache_of

#: Bytes that are hashed together; longer texts are cut at white space.
STEP = 1 << 18
SHINGLE = 5

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the output."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True

#: A random number for each byte, A-Z as a-z; a word's hash is a polynomial in BASE of them.
_BYTES = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))
_BYTES[65:91] = _BYTES[97:123]
BASE = 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = cache_of({}, "shingles", "quality")


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    held = _powers.get(base)
    if held is None or len(held) < n:
        factors = np.full(max(n, STEP + 4096), base, dtype=_U)
        factors[0] = 1
        held = _powers[base] = np.cumprod(factors, dtype=_U)
    return held[:n]


#: Kinds of bytes for ``parts_of``: letters and digits (with all that isn't ASCII), and signs.
_KINDS = np.where(BLANK, 0, 2).astype(np.int8)
_KINDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 1
_WORDS = np.where(BLANK, 0, 1).astype(np.int8)
_CASED = mix((np.arange(256, dtype=_U) + _U(1)) * _U(0x9E3779B97F4A7C15))


def word_hashes(data: np.ndarray, kinds: np.ndarray = _WORDS, values: np.ndarray = _BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Where words begin in a byte array, and their hashes: longest runs of bytes of one kind other than 0.

    By default words are ``[^\\x20\\x09-\\x0D]+`` and A-Z count as a-z.
    """
    n = len(data)
    if n > 2 * STEP:
        blank = np.flatnonzero(BLANK[data])
        cuts, last = [0], 0
        while n - last > 2 * STEP:
            k = np.searchsorted(blank, last + STEP)
            if k == len(blank):
                break
            last = int(blank[k])
            cuts.append(last)
        if len(cuts) > 1:
            parts = [word_hashes(data[a:b], kinds, values) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]
            return np.concatenate([s + c for c, (s, _) in zip(cuts, parts, strict=True)]), np.concatenate([h for _, h in parts])
    kind = np.zeros(n + 2, dtype=np.int8)
    kind[1:-1] = kinds[data]
    edge = kind[1:] != kind[:-1]
    starts, ends = np.flatnonzero(edge & (kind[1:] != 0)), np.flatnonzero(edge & (kind[:-1] != 0))
    if not len(starts):
        return starts, np.zeros(0, dtype=_U)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(values[data] * _power(BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(pow(BASE, -1, 1 << 64), n)[starts]
    return starts, mix(hashes + (ends - starts).astype(_U) * _U(0x9E3779B97F4A7C15))


def words_of(texts: list[bytes], kinds: np.ndarray = _WORDS, values: np.ndarray = _BYTES) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of ``texts`` in turn, and where each text's begin (one more at the end)."""
    joined = b"\n".join(texts)
    starts, hashes = word_hashes(np.frombuffer(joined, np.uint8), kinds, values)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return hashes, np.searchsorted(starts, begins)


def parts_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Like ``words_of``, with case, and with signs as words apart from letters and digits."""
    return words_of(texts, _KINDS, _CASED)


def sequences(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words."""
    out = hashes[: max(0, len(hashes) - n + 1)]
    for k in range(1, n):
        out = mix(out + _U(k)) * _U(0x9E3779B97F4A7C15) + hashes[k : len(out) + k]
    return mix(out)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted hashes; one for all words where they are fewer than ``size``, none without words."""
    hashes, at = words_of(texts)
    runs, out = sequences(hashes, size), []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        elif b > a:
            out.append(sequences(hashes[a:b], b - a) + _U(b - a))
        else:
            out.append(np.zeros(0, dtype=_U))
    return out
