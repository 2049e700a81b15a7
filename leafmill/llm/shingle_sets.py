"""Word shingles of many texts at once, as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from leafmill.llm.arrowtext import U64, Roller, byte_values, lowered, mix64, words_of

_BYTES = byte_values(11)
_BASE = 0x9E3779B97F4A7C15
_STEP = U64(0xD6E8FEB86659FD93)


def word_hashes(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z lower-cased) and the offsets of each row's first; rows never share a word."""
    starts, ends, rows = words_of(raw, at)
    if not len(starts):
        return np.zeros(0, U64), rows
    hashes = Roller(_BYTES[lowered(raw)], _BASE).slices(starts, ends)
    return mix64(hashes + (ends - starts).astype(U64) * _STEP), rows


def shingle_sets(raw: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each row's shingles of ``words`` words, flat, and the rows' offsets.

    Fewer words than a shingle: the whole sequence as one; none: none. raw, at: the bytes of all rows and the rows' offsets.
    """
    hashes, first = word_hashes(raw, at)
    counts = np.diff(first)
    n_rows = len(counts)
    if not len(hashes):
        return np.zeros(0, U64), np.zeros(n_rows + 1, np.int64)
    sizes = np.where(counts == 0, 0, np.maximum(counts - words + 1, 1))
    row = np.repeat(np.arange(n_rows), sizes)
    ends = np.cumsum(sizes)
    place = first[row] + np.arange(len(row)) - (ends - sizes)[row]
    length = np.minimum(counts, words)[row]
    out = length.astype(U64) * _STEP
    for k in range(words):
        own = hashes[np.minimum(place + k, len(hashes) - 1)]
        out = np.where(k < length, mix64(out + own * _STEP + U64(k + 1)), out)
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[new], row[new]
    return out, np.searchsorted(row, np.arange(n_rows + 1))
