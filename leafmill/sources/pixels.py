"""Pixels of image files: reading, cutting out, scaling and writing them, in numpy.

Read: PNG of every depth and colour type without interlacing, uncompressed BMP of 8, 24 or 32 bits, uncompressed TIFF strips of
8-bit grey or RGB, each frame. Other files raise ``ValueError``, which becomes an error of their row.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples of a picture at most, so that a small file cannot fill a worker's memory.
MOST_SAMPLES = 1 << 28
#: Channels of each PNG colour type (grey, RGB, palette, grey with alpha, RGB with alpha).
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def decode(content: bytes, frame: int = 1) -> np.ndarray:
    """Samples ``(height, width, channels)`` of a frame, from one; palettes are resolved, 16-bit samples keep their high byte."""
    if content[:8] == SIGNATURE:
        return _only(frame, _png(content))
    if content[:2] == b"BM":
        return _only(frame, _bmp(content))
    if content[:4] in (b"II*\0", b"MM\0*"):
        return _tiff(content, frame)
    raise ValueError("pixels of this kind of file are not read")


def _only(frame: int, pixels: np.ndarray) -> np.ndarray:
    if frame != 1:
        raise ValueError(f"no frame {frame}")
    return pixels


def _checked(width: int, height: int, channels: int) -> None:
    if width < 1 or height < 1 or width * height * channels > MOST_SAMPLES:
        raise ValueError(f"a picture of {width} by {height}")


def _chunks(content: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 12 <= len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        yield kind, content[at + 8 : at + 8 + size]
        at += 12 + size


def _png(content: bytes) -> np.ndarray:
    head, palette, packed = None, None, []
    for kind, data in _chunks(content):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"PLTE":
            palette = np.frombuffer(data, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if interlaced or colour not in CHANNELS or depth not in (1, 2, 4, 8, 16) or (colour == 3 and palette is None):
        raise ValueError("interlaced, or of an unknown kind")
    channels = CHANNELS[colour]
    _checked(width, height, channels)
    row = (width * channels * depth + 7) // 8
    raw = zlib.decompressobj().decompress(b"".join(packed), (row + 1) * height)
    if len(raw) < (row + 1) * height:
        raise ValueError("samples are missing")
    lines = np.frombuffer(raw, np.uint8).reshape(height, row + 1)
    flat = _unfiltered(lines[:, 0], lines[:, 1:], max(1, channels * depth // 8))
    if depth == 16:
        flat = flat[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = (bits * (1 << np.arange(depth)[::-1])).sum(axis=2).astype(np.uint8)[:, : width * channels]
        if colour == 0:
            flat = flat * np.uint8(255 // ((1 << depth) - 1))
    pixels = flat.reshape(height, width, channels)
    if colour != 3:
        return pixels
    if pixels.max() >= len(palette):
        raise ValueError("a colour that the palette lacks")
    return palette[pixels[:, :, 0]]


def _predicted(kind: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray) -> np.ndarray:
    """What each of the five row filters expects of a sample, by its neighbours."""
    guess = left + up - corner
    near_left, near_up, near_corner = np.abs(guess - left), np.abs(guess - up), np.abs(guess - corner)
    paeth = np.where((near_left <= near_up) & (near_left <= near_corner), left, np.where(near_up <= near_corner, up, corner))
    return np.select([kind == 1, kind == 2, kind == 3, kind == 4], [left, up, (left + up) // 2, paeth], 0)


#: What a diagonal costs, in samples undone one after the other.
DIAGONAL = 200


def _unfiltered(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Rows without their filters. Rows that lean on one side alone are done at once. Of those that need both their left and the row
    above, few samples are done one by one; if there are many, the picture is done by diagonals, whose samples are independent.
    """
    if kinds.max() > 4:
        raise ValueError("an unknown row filter")
    height, row = lines.shape
    width = row // step
    if np.count_nonzero(kinds > 2) * row > DIAGONAL * (height + width):
        return _by_diagonals(kinds, lines.reshape(height, width, step)).reshape(height, row)
    out = lines.copy()
    for y in np.flatnonzero(kinds):
        if kinds[y] == 1:
            out[y] = np.cumsum(out[y].reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kinds[y] == 2 and y:
            out[y] += out[y - 1]
        elif kinds[y] > 2:
            out[y] = _one_by_one(int(kinds[y]), lines[y].tolist(), out[y - 1].tolist() if y else [0] * row, step)
    return out


def _one_by_one(kind: int, given: list[int], above: list[int], step: int) -> list[int]:
    """A row of filter three or four."""
    out = [0] * step
    add = out.append
    if kind == 3:
        for x, (sample, up) in enumerate(zip(given, above, strict=True)):
            add((sample + ((out[x] + up) >> 1)) & 255)
        return out[step:]
    for x, (sample, up, corner) in enumerate(zip(given, above, [0] * step + above)):
        left = out[x]
        to_left, to_up = up - corner, left - corner
        near_left, near_up, near_corner = abs(to_left), abs(to_up), abs(to_left + to_up)
        if near_left <= near_up and near_left <= near_corner:
            add((sample + left) & 255)
        else:
            add((sample + (up if near_up <= near_corner else corner)) & 255)
    return out[step:]


def _by_diagonals(kinds: np.ndarray, given: np.ndarray) -> np.ndarray:
    height, width, step = given.shape
    out = np.zeros((height + 1, width + 1, step), dtype=np.int16)
    for diagonal in range(height + width - 1):
        y = np.arange(max(0, diagonal - width + 1), min(height, diagonal + 1))
        x = diagonal - y
        guess = _predicted(kinds[y][:, None], out[y + 1, x], out[y, x + 1], out[y, x])
        out[y + 1, x + 1] = (given[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def encode(pixels: np.ndarray, dpi: int | None = None, kinds: np.ndarray | int = 0) -> bytes:
    """A PNG of 8-bit samples; ``kinds`` are the row filters to use."""
    height, width, channels = pixels.shape
    kinds = np.broadcast_to(np.asarray(kinds, dtype=np.uint8), height)
    rows = np.ascontiguousarray(pixels, dtype=np.uint8).reshape(height, width * channels)
    if kinds.any():
        around = np.zeros((height + 1, width + 1, channels), dtype=np.int16)
        around[1:, 1:] = pixels
        guess = _predicted(kinds[:, None, None], around[1:, :-1], around[:-1, 1:], around[:-1, :-1])
        rows = ((around[1:, 1:] - guess) & 255).astype(np.uint8).reshape(height, width * channels)
    colour = next(c for c, n in CHANNELS.items() if n == channels)
    parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0))]
    if dpi is not None:
        per_metre = round(dpi / 0.0254)
        parts.append((b"pHYs", struct.pack(">IIB", per_metre, per_metre, 1)))
    parts += [(b"IDAT", zlib.compress(np.hstack((kinds[:, None], rows)).tobytes())), (b"IEND", b"")]
    return SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def _bmp(content: bytes) -> np.ndarray:
    start, head, width, height, _, depth, packing = struct.unpack("<IIiiHHI", content[10:34])
    if packing or depth not in (8, 24, 32):
        raise ValueError("a compressed BMP, or of another depth")
    _checked(width, abs(height), depth // 8)
    row = (width * depth // 8 + 3) // 4 * 4
    lines = np.frombuffer(content, np.uint8, row * abs(height), start).reshape(abs(height), row)[:, : width * depth // 8]
    lines = lines[::-1] if height > 0 else lines
    pixels = lines.reshape(abs(height), width, depth // 8)
    if depth == 8:
        (colours,) = struct.unpack("<I", content[46:50])
        table = np.frombuffer(content, np.uint8, 4 * (colours or 256), 14 + head).reshape(-1, 4)
        if pixels.max() >= len(table):
            raise ValueError("a colour that the palette lacks")
        pixels = table[pixels[:, :, 0]]
    return pixels[:, :, 2::-1]


def _tiff(content: bytes, frame: int) -> np.ndarray:
    order = "<" if content[:2] == b"II" else ">"
    (at,) = struct.unpack_from(order + "I", content, 4)
    for _ in range(frame - 1):
        (count,) = struct.unpack_from(order + "H", content, at)
        (at,) = struct.unpack_from(order + "I", content, at + 2 + 12 * count)
        if not at:
            raise ValueError(f"no frame {frame}")
    tags: dict[int, tuple[int, ...]] = {}
    for k in range(struct.unpack_from(order + "H", content, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", content, at + 2 + 12 * k)
        if kind in (3, 4):
            code = f"{order}{n}{'H' if kind == 3 else 'I'}"
            where = at + 10 + 12 * k
            tags[tag] = struct.unpack_from(code, content, where if struct.calcsize(code) <= 4 else struct.unpack_from(order + "I", content, where)[0])
    one = lambda tag, default=0: tags.get(tag, (default,))[0]
    width, height, channels, photometric = one(256), one(257), one(277, 1), one(262, 1)
    if one(259, 1) != 1 or set(tags.get(258, (1,))) != {8} or one(284, 1) != 1 or photometric not in (0, 1, 2) or 273 not in tags:
        raise ValueError("a compressed TIFF, or of another depth or colour model")
    _checked(width, height, channels)
    sizes = tags.get(279) or (width * height * channels,)
    data = b"".join(content[a : a + n] for a, n in zip(tags[273], sizes, strict=True))
    pixels = np.frombuffer(data, np.uint8, width * height * channels).reshape(height, width, channels)
    return 255 - pixels if photometric == 0 else pixels


def _resampled(pixels: np.ndarray, axis: int, first: int, last: int, size: int) -> np.ndarray:
    """Places ``first`` to ``last`` of the axis at its new ``size``: means of what falls on a place, or the one sample under it."""
    given = pixels.shape[axis]
    starts = np.arange(first, last) * given // size
    end = max(starts[-1] + 1, last * given // size)
    part = np.take(pixels, np.arange(starts[0], end), axis)
    total = np.add.reduceat(part, starts - starts[0], axis)
    shape = [1] * pixels.ndim
    shape[axis] = -1
    return total / np.maximum(1, np.diff(np.append(starts, end))).reshape(shape)


def cut(pixels: np.ndarray, box: tuple[float, float, float, float], page: tuple[float, float], scale: float = 1.0) -> np.ndarray:
    """The part of a page's picture in ``box``, of a page of size ``page`` drawn at ``scale``; what lies off the page is left out."""
    size = [max(1, round(v * scale)) for v in page]
    left, right = (min(size[0], max(0, round(v * scale))) for v in (box[0], box[2]))
    top, bottom = (min(size[1], max(0, round(v * scale))) for v in (box[1], box[3]))
    if right <= left or bottom <= top:
        raise ValueError("nothing of the box is on the page")
    if size == [pixels.shape[1], pixels.shape[0]]:
        return pixels[top:bottom, left:right].astype(np.uint8)
    rows = _resampled(pixels.astype(np.float64), 0, top, bottom, size[1])
    return np.rint(_resampled(rows, 1, left, right, size[0])).astype(np.uint8)


#: Bytes of pictures that are handed on together, about.
HANDED_ON = 1 << 20


def handed_on(rows: Iterator[tuple], schema: pa.Schema, picture: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some megabyte of the bytes in their column ``picture``, so that many small ones cost no batch each."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[picture] or b"") + 256
        if size >= HANDED_ON:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


IMAGES = "page_no int, id int, width int, height int, dpi int, png binary, error string"


def images(files: DataFrame, boxes: DataFrame, scale: float = 1.0) -> DataFrame:
    """A PNG for each of ``boxes`` (doc_id, page_no, id, l, t, r, b, page_width, page_height; top left), of ``files`` (doc_id, content).

    Returns ``(doc_id, page_no, id, width, height, dpi, png, error)``. A box without sides, a page that cannot be decoded and a file that
    is missing are rows with an error. Each file goes to one task with the boxes of its document; a page is decoded once,
    and pictures are handed on in batches of about a megabyte.
    """
    names = ["page_no", "id", "l", "t", "r", "b", "page_width", "page_height"]
    kinds = ["int", "int"] + ["double"] * 6
    wanted = boxes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*(F.col(c).cast(k).alias(c) for c, k in zip(names, kinds, strict=True))))).alias("boxes"))
    key = dict(files.dtypes)["doc_id"]

    columns = [("page_no", pa.int32()), ("id", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("dpi", pa.int32()), ("png", pa.binary()), ("error", pa.string())]

    def drawn(doc_id: object, content: bytes | None, wanted: list[dict]) -> Iterator[tuple]:
        seen, pixels, fault = None, None, None
        for x in wanted:
            if x["page_no"] != seen or pixels is None and fault is None:
                seen, pixels, fault = x["page_no"], None, None
                try:
                    pixels = decode(content or b"", seen or 0)
                except Exception as e:  # whatever a file makes the reader raise belongs to its pages
                    fault = f"{type(e).__name__}: {e}"
            made, error = (None, None, None, None), fault
            try:
                if not fault and any(x[c] is None for c in names[2:]):
                    error = "a box or page without sides"
                elif not fault:
                    part = cut(pixels, tuple(x[c] for c in "ltrb"), (x["page_width"], x["page_height"]), scale)
                    made = (part.shape[1], part.shape[0], int(72 * scale), encode(part, int(72 * scale)))
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
            yield doc_id, x["page_no"], x["id"], *made, error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, contents, lists = (batch.column(c) for c in ("doc_id", "content", "boxes"))
            schema = pa.schema([("doc_id", ids.type), *columns])
            rows = (row for n in range(batch.num_rows) for row in drawn(ids[n].as_py(), contents[n].as_py(), lists[n].as_py()))
            yield from handed_on(rows, schema, schema.names.index("png"))

    joined = wanted.join(files.select("doc_id", "content"), "doc_id", "left")
    return joined.select("doc_id", "content", "boxes").mapInArrow(run, f"doc_id {key}, {IMAGES}")
