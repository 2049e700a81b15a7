"""Vectorised byte-level helpers shared by the Arrow-batched operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: ASCII white space: 0x20 and 0x09-0x0D, as in the word pattern [^\x20\x09-\x0D]+.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift-multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_values(seed: int) -> np.ndarray:
    """A fixed pseudo-random odd 64-bit value for each byte."""
    return mix64(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed)) | U64(1)


#: Bytes (or tokens) that are hashed at once; longer texts are cut into overlapping pieces of this size.
PIECE = 250_000
_KEPT = 1 << 20


class Roller:
    """Polynomial hashes of any slice of a token array, modulo 2**64."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        power, inverse = self.powers(base, n + 1)
        self.inverse = inverse
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(values * power[:n], out=self.sums[1:])

    @classmethod
    def powers(cls, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base and its inverse; those of up to ``_KEPT`` tokens (16 MB) are kept, longer ones are not."""
        have = cls._powers.get(base)
        if have is not None and len(have[0]) >= n:
            return have
        size = 1 << max(12, int(n - 1).bit_length()) if n <= _KEPT else n
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.ones(size, U64)
            p[1:] = U64(b)
            np.cumprod(p, out=p)
            out.append(p)
        if n <= _KEPT:
            cls._powers[base] = (out[0], out[1])
        return out[0], out[1]

    def slices(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def all_of(self, width: int) -> np.ndarray:
        """Hashes of every slice of ``width`` tokens."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, U64)
        return (self.sums[width:] - self.sums[:-width]) * self.inverse[:n]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text or binary column's bytes, and the row offsets into them; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def sliced(batches: Iterator[pa.RecordBatch], column: str | int, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Batches cut so that each holds about ``most`` bytes of ``column``, or a single row."""
    for batch in batches:
        _, at = utf8(batch.column(column if isinstance(column, int) else batch.schema.get_field_index(column)))
        row, n = 0, batch.num_rows
        while row < n:
            end = max(row + 1, int(np.searchsorted(at, at[row] + most, side="right")) - 1)
            yield batch.slice(row, min(end, n) - row)
            row = min(end, n)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; at the end of the task its free memory and the powers kept go back, since workers live on between stages."""
    try:
        yield from batches
    finally:
        Roller._powers.clear()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # no glibc
            pass


def words_of(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and the offsets of each row's first word; rows never share a word."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    solid = ~_SPACE[raw]
    begin, stop = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    stop[:-1] &= ~solid[1:]
    cuts = at[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(raw))]
    begin[cuts] = solid[cuts]  # a row's first byte starts a word
    stop[cuts - 1] = solid[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, at)


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, every other byte as it is."""
    return np.where((raw >= 65) & (raw <= 90), raw | 32, raw)
