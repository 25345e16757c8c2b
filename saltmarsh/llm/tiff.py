"""TIFF: write byte payloads as images, walk image directories and decode one row per page."""

from __future__ import annotations

import math
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of the TIFF 6.0 specification and its Deflate and BigTIFF supplements:
# tags, field types (format, size) and compression schemes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, FILL_ORDER = 256, 257, 258, 259, 262, 266
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 322, 323, 324, 325, 339
TYPES = {1: ("B", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4), 16: ("Q", 8), 18: ("Q", 8)}
SCHEMES = {1: "none", 5: "lzw", 8: "deflate", 32946: "deflate", 32773: "packbits"}
CODES = {"none": 1, "lzw": 5, "deflate": 8, "packbits": 32773}
CLEAR, END = 256, 257


class TiffError(ValueError):
    """The bytes aren't a TIFF that this module reads."""


def packbits_decode(data: bytes) -> bytes:
    out, at, size = bytearray(), 0, len(data)
    while at < size:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def packbits_encode(row: bytes) -> bytes:
    out, literal, at, size = bytearray(), bytearray(), 0, len(row)

    def flush():
        for k in range(0, len(literal), 128):
            part = literal[k : k + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < size:
        end = at + 1
        while end < size and end - at < 128 and row[end] == row[at]:
            end += 1
        if end - at >= 3:
            flush()
            out += bytes((257 - (end - at), row[at]))
        else:
            literal += row[at:end]
        at = end
    flush()
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Most significant bit first; codes widen one entry early, as TIFF has it."""
    roots = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, held, bits, last, out = list(roots), 9, 0, 0, None, []
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, width, last = list(roots), 9, None
            continue
        if last is None:
            if code >= 256:
                raise TiffError("LZW data start with a code that isn't a byte")
            entry = roots[code]
        else:
            if code > len(table):
                raise TiffError("LZW code out of range")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    roots = {bytes((i,)): i for i in range(256)}
    table, width, held, bits, out = dict(roots), 9, 0, 0, bytearray()

    def emit(code):
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    emit(CLEAR)
    size, word = 258, b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in table:
            word = longer
            continue
        emit(table[word])
        table[longer] = size
        size += 1
        if size >= 4094:
            emit(CLEAR)
            table, width, size = dict(roots), 9, 258
        elif size >= 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        emit(table[word])
        size += 1
        if size >= 1 << width and width < 12:
            width += 1
    emit(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def compress(data: bytes, scheme: str, row_bytes: int) -> bytes:
    if scheme == "deflate":
        return zlib.compress(data, 1)
    if scheme == "lzw":
        return lzw_encode(data)
    if scheme == "packbits":
        return b"".join(packbits_encode(data[i : i + row_bytes]) for i in range(0, len(data), row_bytes))
    return data


def decompress(data: bytes, scheme: str) -> bytes:
    try:
        return {"none": bytes, "deflate": zlib.decompress, "lzw": lzw_decode, "packbits": packbits_decode}[scheme](data)
    except (zlib.error, IndexError) as e:
        raise TiffError(f"bad {scheme} data") from e


@dataclass
class Page:
    """One image: samples as an array of rows x columns x samples."""

    pixels: np.ndarray
    scheme: str = "deflate"
    predictor: int = 2
    tile: tuple[int, int] | None = None  # rows, columns; multiples of 16
    rows_per_strip: int = 1024
    planar: int = 1
    fields: dict = field(default_factory=dict)


def _difference(block: np.ndarray) -> np.ndarray:
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


def write_tiff(pages: list[Page], order: str = "<") -> bytes:
    """A classic TIFF file: ``order`` is ``<`` (II) or ``>`` (MM)."""
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        pixels = page.pixels if page.pixels.ndim == 3 else page.pixels[:, :, None]
        height, width, samples = pixels.shape
        pixels = pixels.astype(pixels.dtype.newbyteorder(order))
        planes = [pixels] if page.planar == 1 else [pixels[:, :, k : k + 1] for k in range(samples)]
        offsets, counts = [], []
        for plane in planes:
            if page.tile:
                rows, columns = page.tile
                high, wide = math.ceil(height / rows) * rows, math.ceil(width / columns) * columns
                padded = np.zeros((high, wide, plane.shape[2]), plane.dtype)
                padded[:height, :width] = plane
                blocks = [padded[y : y + rows, x : x + columns] for y in range(0, high, rows) for x in range(0, wide, columns)]
            else:
                blocks = [plane[y : y + page.rows_per_strip] for y in range(0, height, page.rows_per_strip)]
            for block in blocks:
                data = (_difference(block) if page.predictor == 2 else block).tobytes()
                stored = compress(data, page.scheme, len(data) // block.shape[0])
                offsets.append(len(out))
                counts.append(len(stored))
                out += stored
        entries = {WIDTH: [width], LENGTH: [height], BITS: [pixels.dtype.itemsize * 8] * samples, COMPRESSION: [CODES[page.scheme]], PHOTOMETRIC: [1 if samples == 1 else 2], SAMPLES: [samples], PLANAR: [page.planar], PREDICTOR: [page.predictor]}
        if page.tile:
            entries |= {TILE_LENGTH: [page.tile[0]], TILE_WIDTH: [page.tile[1]], TILE_OFFSETS: offsets, TILE_COUNTS: counts}
        else:
            entries |= {ROWS_PER_STRIP: [page.rows_per_strip], STRIP_OFFSETS: offsets, STRIP_COUNTS: counts}
        entries |= page.fields
        packed = {}
        for tag, values in entries.items():
            data = struct.pack(f"{order}{len(values)}I", *values)
            if len(data) > 4:
                packed[tag] = struct.pack(f"{order}I", len(out))
                out += data
            else:
                packed[tag] = data
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries))
        for tag in sorted(entries):
            out += struct.pack(f"{order}HHI", tag, 4, len(entries[tag])) + packed[tag]
        link = len(out)
        out += struct.pack(f"{order}I", 0)
    return bytes(out)


def _directories(data: bytes):
    """The image directories in turn, as tag -> values, and the byte order."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise TiffError("no TIFF header")
    magic = struct.unpack_from(f"{order}H", data, 2)[0]
    if magic == 43:
        count_format, entry_size, inline, pointer, at = "Q", 20, 8, "Q", struct.unpack_from(f"{order}Q", data, 8)[0]
    elif magic == 42:
        count_format, entry_size, inline, pointer, at = "H", 12, 4, "I", struct.unpack_from(f"{order}I", data, 4)[0]
    else:
        raise TiffError("no TIFF header")
    seen = set()
    while at:
        if at in seen:
            raise TiffError("image directories form a circle")
        seen.add(at)
        n = struct.unpack_from(f"{order}{count_format}", data, at)[0]
        base, tags = at + struct.calcsize(count_format), {}
        for k in range(n):
            here = base + k * entry_size
            tag, kind = struct.unpack_from(f"{order}HH", data, here)
            count = struct.unpack_from(f"{order}{pointer}", data, here + 4)[0]
            if kind not in TYPES:
                continue
            letter, width = TYPES[kind]
            where = here + entry_size - inline
            if width * count > inline:
                where = struct.unpack_from(f"{order}{pointer}", data, where)[0]
            tags[tag] = struct.unpack_from(f"{order}{count}{letter}", data, where)
        at = struct.unpack_from(f"{order}{pointer}", data, base + n * entry_size)[0]
        yield order, tags


def _decode_page(data: bytes, order: str, tags: dict) -> tuple[np.ndarray, str, int]:
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
    bits, scheme = one(BITS, 1), SCHEMES.get(one(COMPRESSION, 1))
    predictor, planar = one(PREDICTOR, 1), one(PLANAR, 1)
    if not width or not height or scheme is None or bits not in (8, 16, 32) or set(tags.get(BITS, (1,))) != {bits} or predictor not in (1, 2) or one(FILL_ORDER, 1) != 1:
        raise TiffError("a page of a kind that isn't read")
    kind = np.dtype(f"u{bits // 8}").newbyteorder(order)
    tiled = TILE_WIDTH in tags
    rows, columns = (one(TILE_LENGTH), one(TILE_WIDTH)) if tiled else (min(one(ROWS_PER_STRIP, height), height), width)
    offsets, counts = (tags.get(TILE_OFFSETS), tags.get(TILE_COUNTS)) if tiled else (tags.get(STRIP_OFFSETS), tags.get(STRIP_COUNTS))
    if not rows or not columns or not offsets or not counts or len(offsets) != len(counts):
        raise TiffError("a page without its strips or tiles")
    down, across = math.ceil(height / rows), math.ceil(width / columns)
    planes, depth = (samples, 1) if planar == 2 else (1, samples)
    if len(offsets) < planes * down * across:
        raise TiffError("a page without its strips or tiles")
    image = np.empty((height, width, samples), kind.newbyteorder("="))
    for i in range(planes * down * across):
        plane, y, x = i // (down * across), i // across % down * rows, i % across * columns
        high = rows if tiled else min(rows, height - y)
        block = decompress(data[offsets[i] : offsets[i] + counts[i]], scheme)
        need = high * columns * depth * kind.itemsize
        if len(block) < need:
            raise TiffError("a strip or tile is too short")
        block = np.frombuffer(block, kind, high * columns * depth).reshape(high, columns, depth).astype(kind.newbyteorder("="))
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=block.dtype)
        image[y : y + high, x : x + columns, plane : plane + depth] = block[: height - y, : width - x]
    return image, scheme, predictor


def read_tiff(data: bytes):
    """Each page in turn: (samples as rows x columns x samples, scheme, predictor)."""
    try:
        for order, tags in _directories(data):
            yield _decode_page(data, order, tags)
    except struct.error as e:
        raise TiffError("the file ends too soon") from e
    except (ArithmeticError, LookupError, ValueError, MemoryError) as e:
        if isinstance(e, TiffError):
            raise
        raise TiffError(f"the file's numbers make no sense: {type(e).__name__}") from e


def describe(image: np.ndarray) -> str:
    """Size, mean, deviation and entropy (bits) of an image's samples."""
    values = image.ravel()
    if not values.size:
        raise TiffError("a page without samples")
    odds = np.bincount(values if values.dtype == np.uint8 else values.astype(np.int64) & 255, minlength=256) / values.size
    odds = odds[odds > 0]
    return f"{image.shape[1]}x{image.shape[0]}x{image.shape[2]};mean={values.mean(dtype=np.float64):.4f};std={values.std(dtype=np.float64):.4f};entropy={max(0.0, -(odds * np.log2(odds)).sum()):.4f}"


def _batches(rows, names, kinds, size=4 << 20, weigh=lambda r: 0):
    """Arrow batches of about ``size`` bytes of the rows that ``rows`` yields."""
    import pyarrow as pa

    held, n = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
    for row in rows:
        held.append(row)
        n += weigh(row)
        if n >= size or len(held) >= 4096:
            yield make()
            held, n = [], 0
    if held:
        yield make()


def store_texts(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", width: int = 64, scheme: str = "deflate", predictor: int = 2, rows_per_strip: int = 1024) -> DataFrame:
    """Each text as a TIFF page of 8-bit samples: the id, ``n_bytes`` and ``media``.

    The payload is the text in UTF-8 and zeros up to a positive multiple of ``width``.
    A null text is empty. One row for each input row, whatever its id.
    """

    def store(batches):
        import pyarrow as pa

        def rows(batch):
            for ident, value in zip(batch.column("_id").to_pylist(), batch.column("_text"), strict=True):
                data = value.as_buffer().to_pybytes() if value.is_valid else b""
                height = max(1, -(-len(data) // width))
                pixels = np.frombuffer(data.ljust(height * width, b"\0"), np.uint8).reshape(height, width, 1)
                yield ident, len(data), write_tiff([Page(pixels, scheme, predictor, rows_per_strip=rows_per_strip)])

        for batch in batches:
            yield from _batches(rows(batch), ["_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()], weigh=lambda r: len(r[2]))

    source = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    return source.mapInArrow(store, "_id long, n_bytes long, media binary").withColumnRenamed("_id", id_col)


def tiff_pages(files: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each page of each TIFF file in ``media_col``.

    Reads classic and BigTIFF files in either byte order; strips and tiles, stored as they
    are or by PackBits, LZW or deflate; horizontal predictors; unsigned samples of 8, 16
    or 32 bits, interleaved or in planes. Columns: those of ``keep``, then ``page`` (from
    0), ``width``, ``height``, ``samples``, ``bits``, ``scheme``, ``predictor``,
    ``pixels`` (rows of interleaved samples, little-endian), ``feature`` and ``error``.

    A file that can't be read on gives a row with ``error`` and null pixels after the
    pages before the fault. A null file gives none. Equal files give equal rows.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.select(*keep).schema)

    def decode(batches):
        import pyarrow as pa

        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.binary(), pa.string(), pa.string()]
        names = ["page", "width", "height", "samples", "bits", "scheme", "predictor", "pixels", "feature", "error"]

        def rows(batch):
            kept = [batch.column(c).to_pylist() for c in keep]
            for i, value in enumerate(batch.column("_media")):
                if not value.is_valid:
                    continue
                own, page = tuple(k[i] for k in kept), 0
                try:
                    for image, scheme, predictor in read_tiff(value.as_buffer().to_pybytes()):
                        height, width, samples = image.shape
                        feature = describe(image)
                        yield *own, page, width, height, samples, image.itemsize * 8, scheme, predictor, image.astype(image.dtype.newbyteorder("<")).tobytes(), feature, None
                        page += 1
                except TiffError as e:
                    yield *own, page, None, None, None, None, None, None, None, None, str(e)

        for batch in batches:
            own = [batch.schema.field(c).type for c in keep]
            yield from _batches(rows(batch), [*keep, *names], [*own, *kinds], weigh=lambda r: len(r[-3] or b""))

    source = files.select(*keep, F.col(media_col).alias("_media"))
    return source.mapInArrow(decode, f"{schema}, page int, width int, height int, samples int, bits int, scheme string, predictor int, pixels binary, feature string, error string")
