"""Secrets in texts: patterns, and strings that a tokenizer finds hard to compress."""

from __future__ import annotations

import base64
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saltmarsh.llm.tokens import in_portions
from saltmarsh.llm.worker import cache_of, small_batches, task

# The base patterns and the lengths that their matches need.
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(rb"AKIA[A-Z0-9]{%d,}" % (ACCESS_LEAST - 4))
HEX = re.compile(rb"[0-9a-f]{%d,}" % HEX_LEAST)

#: Kinds in the order that breaks ties; ``random`` is what the token test adds.
KINDS = ("assign", "access", "hex", "random")

RANDOM_LEAST = 20
RUN = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % RANDOM_LEAST)
# Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384 and SHA-512.
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
DIGEST = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
UUID = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
#: Words, alone or joined, each with a short number at most: names, slugs, paths.
IDENTIFIER = re.compile(rb"[/_=+-]*[A-Za-z]*[0-9]{0,4}([/_=+-]+([A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))*[/_=+-]*")

_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True

_encoders: dict = cache_of({}, "secrets")


def _encoder(path: str, pattern: str):
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
        _encoders[path] = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


#: Words of a name in any style of capitals.
HUMP = re.compile(rb"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _in_words(run: bytes) -> bool:
    """Whether letters of mixed case come in words of three or more on average, not in random case."""
    parts = [(len(part), len(HUMP.findall(part))) for part in re.findall(rb"[A-Za-z]+", run)]
    return sum(n for n, k in parts if k > 1) >= 3 * sum(k for _, k in parts if k > 1)


def is_known(run: bytes, digests: frozenset) -> bool:
    """Digests by shape or from the list given, UUIDs, numbers, and identifiers: words, joined, with short numbers."""
    if DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run) or run in digests:
        return True
    return run.isdigit() or IDENTIFIER.fullmatch(run) is not None and _in_words(run)


def _long_chunks(data: bytes) -> list[tuple[int, int]]:
    """Where there are at least RANDOM_LEAST bytes without white space."""
    blank = np.flatnonzero(_BLANK[np.frombuffer(data, np.uint8)])
    edges = np.concatenate(([-1], blank, [len(data)]))
    long = np.flatnonzero(np.diff(edges) > RANDOM_LEAST)
    return list(zip((edges[long] + 1).tolist(), edges[long + 1].tolist(), strict=True))


def find_secrets(data: bytes, encoder, most: float, digests: frozenset = frozenset()) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) in bytes, in order, of one UTF-8 text."""
    found = []
    folded = data.lower()
    if any(w in folded for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    chunks = _long_chunks(data)
    for start, end in chunks:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(data, start, end)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(data, start, end)]
    base = list(found)
    for start, end in chunks:
        for m in RUN.finditer(data, start, end):
            run = m.group()
            if any(s < m.end() and m.start() < e for s, _, e in base) or is_known(run, digests):
                continue
            if len(run) < most * len(encoder.encode_ordinary(run.decode())):
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def _in_characters(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not found or data.isascii():
        return found
    starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
    at = lambda i: int(starts[i - 1]) if i else 0
    return [(at(s), k, at(e)) for s, k, e in found]


def scan_secrets(docs: DataFrame, vocabulary: str, pattern: str, most: float = 2.2, known_digests: frozenset = frozenset(), text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The secrets of each row's whole text: the id and ``spans``, an array of (kind, start, end).

    Kinds ``assign``, ``access`` and ``hex`` are the base patterns. ``random``: runs of at
    least 20 characters of base64 and its URL form that have fewer than ``most`` characters per token under a tiktoken vocabulary. A vocabulary
    learned from text spends few tokens on words and many on random strings. Known
    digests (by shape, or in ``known_digests``), UUIDs, identifiers and runs that a base
    span covers in part are left out.

    Offsets count code points, the end exclusive; spans stand by start, then kind. A null
    text is empty, and an empty one has no spans. Each input row gives one, whatever its
    id. No shuffle; a worker holds one batch of texts at a time.
    """

    @task("secrets")
    def scan(batches):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            encoder, ids = _encoder(vocabulary, pattern), batch.column("_id")
            for portion in in_portions(batch.column("_text")):
                spans = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in _in_characters(data, find_secrets(data, encoder, most, known_digests))] for _, data in portion]
                yield pa.RecordBatch.from_arrays([ids.slice(portion[0][0], len(portion)), pa.array(spans, kind)], ["_id", "spans"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(scan, "_id long, spans array<struct<kind: string, start: long, end: long>>").withColumnRenamed("_id", id_col)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
