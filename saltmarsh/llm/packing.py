"""Best-fit packing of token sequences, by exact complements of lengths."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from saltmarsh.llm.scratch import materialize
from saltmarsh.llm.tokens import in_lots, tokenizer
from saltmarsh.llm.worker import small_batches, task

#: Pieces of one length are numbered in groups of about 1 in so many of all pieces, so
#: no task numbers more than that of one length; there are at most so many groups and
#: one more for each length.
RANK_GROUPS = 1 << 13

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Shelf:
    """Lengths that are still to be had, with their counts, and a hashed index of the sums of one, two and three of them.

    ``pairs`` and ``triples`` have for a sum the combination with the largest first length that the
    counts allow, () for none; they are filled as sums are asked for, ``capacity`` entries each at
    most. Counts only fall, so a combination that they no longer allow never comes back: the next
    one is looked for below it.
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = [0] * (capacity + 1)
        self.bits = 0  # bit i: length i is there
        self.mirror = 0  # bit capacity - i: length i is there
        self.pairs: dict[int, tuple[int, ...]] = {}
        self.triples: dict[int, tuple[int, ...]] = {}
        for length, n in counts.items():
            self.left[length] = n
            self._turn(length)

    def _turn(self, length: int) -> None:
        self.bits ^= 1 << length
        self.mirror ^= 1 << (self.capacity - length)

    def take(self, length: int, n: int) -> None:
        self.left[length] -= n
        if n and not self.left[length]:
            self._turn(length)

    def largest(self, limit: int) -> int:
        """The largest length there up to ``limit``; 0 if none."""
        return max(0, (self.bits & ((1 << limit + 1) - 1)).bit_length() - 1)

    def allows(self, combination: tuple[int, ...]) -> bool:
        return all(self.left[x] >= combination.count(x) for x in combination)

    def _search(self, total: int, below: int, beside: tuple[int, ...] = ()) -> tuple[int, ...]:
        """Two lengths that add up to ``total``, the first as large as can be under ``below``, which can be had together with ``beside``."""
        # bit a of the shifted mirror: length total - a is there
        sums = self.bits & (self.mirror >> (self.capacity - total)) & ((1 << below) - 1)
        while (a := sums.bit_length() - 1) > 0:
            if self.allows((a, total - a, *beside)):
                return (a, total - a)
            sums ^= 1 << a
        return ()

    def pair(self, total: int) -> tuple[int, ...]:
        """Two lengths there that add up to ``total``, the first as large as can be."""
        found = self.pairs.get(total)
        if found is None or not self.allows(found):
            found = self.pairs[total] = self._search(total, found[0] if found else total)
        return found

    def triple(self, total: int) -> tuple[int, ...]:
        """Three lengths there that add up to ``total``, the first as large as can be."""
        found = self.triples.get(total)
        if found is None or not self.allows(found):
            a = self.largest(found[0] if found else total - 2)
            found = ()
            while not found and a * 3 >= total:
                rest = self.pair(total - a)
                if rest and not self.allows((a, *rest)):
                    rest = self._search(total - a, total - a, (a,))
                found = (a, *rest) if rest else ()
                a = self.largest(a - 1)
            self.triples[total] = found
        return found

    def fill(self, gap: int) -> tuple[int, ...]:
        """One, two or three lengths there that fill ``gap`` exactly; () if none do."""
        return (gap,) if self.left[gap] else self.pair(gap) or self.triple(gap)


def pack_lengths(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """How often to make which combination of lengths: [(lengths, times)].

    Each starts with the largest length left. A gap that one, two or three lengths fill
    exactly is filled with these; else the largest length that fits goes in (best fit) and
    the rest of the gap is tried again. A combination is made as often as the counts allow,
    which uses up one of its lengths, so the work depends on the distinct lengths alone.
    """
    shelf = Shelf({k: v for k, v in counts.items() if v}, capacity)
    made = []
    while shelf.bits:
        combination, gap = [], capacity
        while gap and (length := shelf.largest(gap)):
            found = (length,) if not combination else shelf.fill(gap) or (length,)
            for x in found:
                shelf.take(x, 1)
            combination += found
            gap -= sum(found)
        uses = Counter(combination)
        more = min(shelf.left[x] // n for x, n in uses.items())
        for x, n in uses.items():
            shelf.take(x, n * more)
        made.append((tuple(combination), 1 + more))
    return made


@dataclass
class Slots:
    """Places by length and rank: from ``keys[i]`` (length << 44 | first rank) on, ranks go to bins from ``bins[i]`` on, at ``offsets[i]``."""

    keys: np.ndarray
    bins: np.ndarray
    offsets: np.ndarray

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 44) | rank
        i = np.searchsorted(self.keys, key, side="right") - 1
        return self.bins[i] + key - self.keys[i], self.offsets[i]


def slots_of(made: list[tuple[tuple[int, ...], int]]) -> Slots:
    """The places that the combinations offer."""
    rows, given, first_bin = [], Counter(), 0
    for lengths, times in made:
        offset = 0
        for length in lengths:
            rows.append((length << 44 | given[length], first_bin, offset))
            given[length] += times
            offset += length
        first_bin += times
    rows.sort()
    return Slots(*(np.array([r[k] for r in rows], dtype=np.int64) for k in range(3)))


def _cutter(path: str, capacity: int, end_id: int):
    @task("tokens")
    def cut(batches):
        import zlib

        import pyarrow as pa

        end, step = int(end_id).to_bytes(4, "little"), 4 * capacity
        for docs, texts in in_lots(batches, "_id", "_text"):
            rows = []
            for doc, data in zip(docs, tokenizer(path).ids(texts), strict=True):
                data += end
                rows += [(doc, k, at // 4, min(step, len(data) - at) // 4, zlib.crc32(data[at : at + step])) for k, at in enumerate(range(0, len(data), step))]
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return cut


def cut_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Each document's ids, with ``end_id`` after them, cut into pieces of ``capacity`` where they are more."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(_cutter(tokenizer_path, capacity, end_id), PIECES)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with ``sequence_id`` and ``offset``.

    Only the counts of lengths, ``capacity`` numbers at most, go to the driver, which
    decides what combinations of lengths to make. Each piece then looks its place up by
    its length and its rank among pieces of that length. Ranks are counted in groups of
    bounded size, whose counts (again of a bounded number) are added up on the driver;
    so a length that a third of all pieces have is numbered by many tasks.
    """
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    share = max(1, -(-total // RANK_GROUPS))
    groups_of = {length: -(-n // share) for length, n in counts.items()}
    several = [F.lit(x) for length, g in groups_of.items() if g > 1 for x in (length, g)]
    groups = F.coalesce(F.create_map(*several).getItem(F.col("length")), F.lit(1)) if several else F.lit(1)
    salted = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), groups).cast("int"))
    sizes = salted.groupBy("length", "_g").agg(F.count(F.lit(1)).alias("n")).collect()
    before, seen = {}, Counter()
    for length, g, n in sorted((r["length"], r["_g"], r["n"]) for r in sizes):
        before[length << 20 | g] = seen[length]
        seen[length] += n
    group_keys = np.array(sorted(before), dtype=np.int64)
    group_starts = np.array([before[k] for k in group_keys.tolist()], dtype=np.int64)
    slots = slots_of(pack_lengths(counts, capacity))
    names = pieces.columns

    @task("places")
    def place(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            length, g, nth = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "_g", "_nth"))
            rank = group_starts[np.searchsorted(group_keys, length << 20 | g)] + nth - 1
            bins, offsets = slots.place(length, rank)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(bins), pa.array(offsets)], [*names, "sequence_id", "offset"])

    in_group = W.partitionBy("length", "_g").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("_nth", F.row_number().over(in_group))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All documents packed into sequences of at most ``capacity`` tokens, one row for each piece.

    A null text is empty: its document is the end id alone. Null and repeated ids keep a
    row for each document. An empty table gives no rows. Other columns aren't read.
    """
    pieces = materialize(cut_pieces(docs, tokenizer_path, capacity, end_id, text_col, id_col), "pieces")
    return pack(pieces, capacity)
