"""Repeated windows by a depth-limited radix sort of suffixes.

A suffix matters only through its first ``threshold`` tokens: two suffixes equal that far are a repeated
window. The sort refines groups of suffixes digit by digit, most significant digit first, and a group
of one goes no further:

1. digit one is a 32-byte (or 16-word) block. Each window is filed under the block with the smallest
   hash inside it, so equal windows are filed alike and about 69 neighbouring windows share one record
   (their block, and all tokens that they span). A block found once ends there.
2. digit two is that whole span: equal spans hold equal windows, and all but the first are repeats.
3. where one block has several spans, the windows are filed again in quarters, under the longer stretch
   that a quarter's windows have in common, and last one by one, under the window itself; whatever
   stands alone under its stretch ends there.

Every task keeps just the first of what is equal among its own rows, so that a group, however hot, sends
at most one record a task to any digit's pass. Digits are compared by two independent 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
import zstandard

from leafmill.llm.arrowtext import PIECE, U64, Roller, byte_values, mix64, released, sliced, utf8, words_of
from leafmill.storage import stored

#: Odd multipliers of the rolling hashes.
BASE_BLOCK, BASE_SPAN, BASE_WORD = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
#: Records that a task holds before it files them; sorting them takes some 150 bytes each.
FLUSH = 250_000
ALONE, MARKER, OPEN, GONE = 0, 1, 2, 3

Tokens = tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray | None]


def byte_tokens(raw: np.ndarray, at: np.ndarray) -> Tokens:
    """Token hashes, row offsets in tokens, and each token's byte start and end (None: itself)."""
    return byte_values(1)[raw], at, None, None


def word_tokens(raw: np.ndarray, at: np.ndarray) -> Tokens:
    starts, ends, rows = words_of(raw, at)
    values = byte_values(2)
    hashes = np.zeros(len(starts), U64)
    lo = 0
    while lo < len(starts):  # words of a piece of the bytes at a time
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + PIECE, side="right")))
        base = starts[lo]
        hashes[lo:hi] = Roller(values[raw[base : ends[hi - 1]]], BASE_WORD).slices(starts[lo:hi] - base, ends[lo:hi] - base)
        lo = hi
    return mix64(hashes + (ends - starts).astype(U64)), rows, starts, ends


UNITS: dict[str, tuple[Callable[..., Tokens], int]] = {"bytes": (byte_tokens, 32), "words": (word_tokens, 16)}


def _sliding_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest value of each window, the leftmost of ties (values' low bits must be their positions)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(values) // width)
    padded = np.full(blocks * width, np.iinfo(U64).max, U64)
    padded[: len(values)] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def file_windows(tokens: np.ndarray, at: np.ndarray, threshold: int, block: int) -> dict[str, np.ndarray]:
    """The records of all windows of ``threshold`` tokens inside rows: row, first and last window start (in the row), block and span hash."""
    reach = threshold - block + 1
    names = ("row", "p0", "length", "kh", "ch")
    if len(tokens) < threshold:
        return {n: np.zeros(0, U64 if n in ("kh", "ch") else np.int64) for n in names}
    first = Roller(tokens, BASE_BLOCK)
    blocks = mix64(first.all_of(block))
    position = np.arange(len(blocks), dtype=U64)
    low = _sliding_argmin((blocks & ~U64((1 << 24) - 1)) | position, reach)
    anchor = (low & U64((1 << 24) - 1)).astype(np.int64)
    lengths = np.diff(at)
    row = np.repeat(np.arange(len(lengths)), lengths)[: len(anchor)]
    ok = np.arange(len(anchor)) + threshold <= at[row + 1]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    p0 = np.flatnonzero(new & ok)
    stop = new | ~ok
    ends = np.flatnonzero(stop)
    after = np.searchsorted(ends, p0, side="right")
    p1 = np.where(after < len(ends), np.append(ends, 0)[np.minimum(after, len(ends))], len(anchor)) - 1
    span = Roller(tokens, BASE_SPAN).slices(p0, p1 + threshold)
    a = anchor[p0]
    ch = mix64(span ^ mix64(((a - p0) << 20 | (p1 - p0)).astype(U64)))
    return {"row": row[p0], "p0": p0 - at[row[p0]], "length": _shape(a - p0, p1 - p0), "kh": blocks[a], "ch": ch}


def _shape(off: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Of a record's windows: how far the first lies before the block, and how many follow it."""
    return off << 10 | more


def _pack(p0: np.ndarray, length: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    """length: of what is gone, in tokens; of other records their shape."""
    return p0.astype(np.int64) << 22 | length.astype(np.int64) << 2 | kind


def _unpack(pk: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return pk >> 22, pk >> 2 & (1 << 20) - 1, pk & 3


def _runs(keys: np.ndarray) -> np.ndarray:
    """Ordinal of the run of equal keys that each sorted row is in."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.cumsum(new) - 1


def _merged(doc: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Touching spans of a document joined, as far as a length fits its 20 bits. Sorted by document and start."""
    if not len(doc):
        return doc, start, length
    order = np.lexsort((start, doc))
    doc, start, end = doc[order], start[order], (start + length)[order]
    new = np.ones(len(doc), bool)
    top = end.copy()
    # spans are of similar length and sorted by start, so ends are all but sorted: a running maximum by document settles the rest
    change = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    shift = np.repeat(np.arange(len(change)) * (1 << 40), np.diff(np.append(change, len(doc))))
    top = np.maximum.accumulate(end + shift) - shift
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > top[:-1])
    first = np.flatnonzero(new)
    begin, stop = start[first], top[np.append(first[1:], len(doc)) - 1]
    return doc[first], begin, stop - begin


def _chopped(doc: np.ndarray, start: np.ndarray, length: np.ndarray, most: int = (1 << 20) - 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = np.maximum(1, -(-length // most))
    at = np.repeat(np.arange(len(doc)), parts)
    k = np.arange(len(at)) - np.repeat(np.cumsum(parts) - parts, parts)
    return doc[at], start[at] + k * most, np.minimum(most, length[at] - k * most)


def _rows(kh: np.ndarray, ch: np.ndarray, doc: np.ndarray, pk: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kh.view(np.int64)), pa.array(ch.view(np.int64)), pa.array(doc), pa.array(pk)], names=["kh", "ch", "doc", "pk"])


FILED = "kh long, ch long, doc long, pk long"


def _taken(held: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """All records held, joined by column; none are held after that."""
    out = {n: np.concatenate([h.pop(n) for h in held]) for n in list(held[0])}
    held.clear()
    return out


def _settle_task(r: dict[str, np.ndarray], threshold: int) -> Iterator[pa.RecordBatch]:
    """What one task knows of its own records: repeats are gone, blocks with several spans open."""
    order = np.lexsort((r["p0"], r["doc"], r["ch"], r["kh"]))
    kh, ch, doc, p0, length = (r[n][order] for n in ("kh", "ch", "doc", "p0", "length"))
    if not len(kh):
        return
    new_block, new_span = np.ones(len(kh), bool), np.ones(len(kh), bool)
    new_block[1:] = kh[1:] != kh[:-1]
    new_span[1:] = new_block[1:] | (ch[1:] != ch[:-1])
    spans = np.add.reduceat(new_span.astype(np.int64), np.flatnonzero(new_block))
    many = (spans > 1)[np.cumsum(new_block) - 1]
    kind = np.where(~new_span, GONE, np.where(~many, ALONE, np.where(new_block, MARKER, OPEN)))
    gone = kind == GONE
    d, s, n = _chopped(*_merged(doc[gone], p0[gone], (length[gone] & 1023) + threshold))
    spread = mix64(d.astype(U64))
    yield _rows(spread, np.zeros(len(d), U64), d, _pack(s, n, GONE))
    rest = ~gone
    filed = np.where(kind == OPEN, mix64(doc.astype(U64) + p0.astype(U64)), kh)[rest]
    for k in range(0, len(filed), 100_000):
        part = slice(k, k + 100_000)
        yield _rows(filed[part], ch[rest][part], doc[rest][part], _pack(p0[rest], length[rest], kind[rest])[part])


def file_documents(docs: DataFrame, unit: str, threshold: int, piece: int = PIECE) -> DataFrame:
    """Pass one over ``(doc, text)``."""
    split, block = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0
        for batch in sliced(batches, "text", piece):
            raw, at = utf8(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi, skipped, _, tokens, rows in _pieces(unit, raw, at, threshold - 1, piece):
                r = file_windows(tokens, rows, threshold, block)
                held.append({"kh": r["kh"], "ch": r["ch"], "doc": ids[lo:hi][r.pop("row")], "p0": r["p0"] + skipped, "length": r["length"]})
                count += len(r["kh"])
                if count > FLUSH:
                    yield from _settle_task(_taken(held), threshold)
                    count = 0
        if held:
            yield from _settle_task(_taken(held), threshold)

    return docs.select("doc", "text").mapInArrow(lambda batches: released(run(batches)), FILED)


def _pieces(unit: str, raw: np.ndarray, at: np.ndarray, overlap: int, piece: int) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
    """``(first row, end row, own start, own end, tokens, row offsets)``: a slice of texts at once, or a single long
    text in pieces that overlap by ``overlap`` tokens; a piece starts at its own start in the text."""
    split, _ = UNITS[unit]
    if len(raw) <= 2 * piece:
        tokens, rows, _, _ = split(raw, at)
        yield 0, len(rows) - 1, 0, 1 << 62, tokens, rows
        return
    words = split(raw, at)[:2] if unit == "words" else None
    rows = words[1] if words else at
    for row in range(len(rows) - 1):
        a, b = int(rows[row]), int(rows[row + 1])
        for k in range(a, max(a + 1, b - overlap), piece):
            end = min(b, k + piece + overlap)
            tokens = words[0][k:end] if words else byte_values(1)[raw[k:end]]
            yield row, row + 1, k - a, k - a + piece if end < b else 1 << 62, tokens, np.array([0, end - k])


def _grouped(batches: Iterator[pa.RecordBatch], settle: Callable[[list[np.ndarray]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Calls settle on runs of whole groups of sorted batches (by the first column)."""
    held: list[list[np.ndarray]] = []

    def together() -> list[np.ndarray]:
        return [np.concatenate(c) for c in zip(*held, strict=True)]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [c.to_numpy() for c in batch.columns]
        cut = int(np.searchsorted(cols[0], cols[0][-1]))
        if cut or (held and held[-1][0][-1] != cols[0][-1]):
            held.append([c[:cut] for c in cols])
            yield from settle(together())
            held = []
        held.append([c[cut:] for c in cols])
    if held:
        yield from settle(together())


def settle_spans(filed: DataFrame, threshold: int) -> DataFrame:
    """Pass two: ``(doc, pk)`` of windows that are gone for sure or still open."""

    def settle(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        kh, ch, doc, pk = cols
        p0, length, kind = _unpack(pk)
        through = kind >= OPEN
        out_doc, out_pk = [doc[through]], [pk[through]]
        m = ~through
        kh, ch, doc, p0, length, kind = (x[m] for x in (kh, ch, doc, p0, length, kind))
        if len(kh):
            new_block, new_span = np.ones(len(kh), bool), np.ones(len(kh), bool)
            new_block[1:] = kh[1:] != kh[:-1]
            new_span[1:] = new_block[1:] | (ch[1:] != ch[:-1])
            at = np.flatnonzero(new_block)
            spans = np.add.reduceat(new_span.astype(np.int64), at) + np.add.reduceat((kind == MARKER).astype(np.int64), at)
            open_ = new_span & (spans > 1)[np.cumsum(new_block) - 1]
            gone = ~new_span
            out_doc += [doc[open_], doc[gone]]
            out_pk += [_pack(p0[open_], length[open_], OPEN), _pack(p0[gone], (length[gone] & 1023) + threshold, GONE)]
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_doc)), pa.array(np.concatenate(out_pk))], names=["doc", "pk"])

    ordered = filed.repartition("kh").sortWithinPartitions("kh", "ch", "doc", "pk")
    return ordered.mapInArrow(lambda batches: released(_grouped(batches, settle)), "doc long, pk long")


def _squeezed(docs: DataFrame) -> DataFrame:
    """Texts as zstd frames: what the joins by document move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in sliced(batches, "text"):
            raw, at = utf8(batch.column(1))
            data = raw.tobytes()
            z = [press.compress(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary()), pa.array(np.diff(at))], names=["doc", "z", "size"])

    return docs.select("doc", "text").mapInArrow(lambda batches: released(run(batches)), "doc long, z binary, size long")


def _inflated(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor()
    texts = [expand.decompress(x) for x in column.to_pylist()]
    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
    return np.frombuffer(b"".join(texts), np.uint8), at


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and the row of each value of a list column (null: none)."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False), nan=0).astype(np.int64)
    return flat.astype(np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _slices(batches: Iterator[pa.RecordBatch], open_only: bool, piece: int) -> Iterator[pa.RecordBatch]:
    """Batches of ``(doc, z, size, marks)`` cut to texts of ``piece`` bytes together, or a single longer one."""
    for batch in batches:
        if open_only:
            batch = batch.filter(batch.column(3).is_valid())
        ends = np.cumsum(batch.column(2).to_numpy())
        row, n = 0, batch.num_rows
        while row < n:
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + piece, side="right")))
            yield batch.slice(row, end - row)
            row = end


def file_again(texts: DataFrame, unit: str, threshold: int, width: int, piece: int = PIECE) -> DataFrame:
    """A later pass over ``(doc, z, size, marks)``: open records filed anew in ranges of ``width`` windows.

    A range counts from the block, so it is the same in every text; it is filed under the stretch that
    its windows have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        count = 0
        for batch in _slices(batches, True, piece):
            ids = batch.column(0).to_numpy()
            pk, row = _lists(batch.column(3))
            p0, shape, kind = _unpack(pk)
            gone = kind == GONE
            d, s, n = _chopped(*_merged(ids[row[gone]], p0[gone], shape[gone]))
            yield _rows(mix64(d.astype(U64)), np.zeros(len(d), U64), d, _pack(s, n, GONE))
            p0, off, more, row = p0[~gone], shape[~gone] >> 10, shape[~gone] & 1023, row[~gone]
            if not len(p0):
                continue
            raw, at = _inflated(batch.column(1))
            # a record lies within two thresholds of its start, so a piece's records are whole in it
            for lo, hi, skipped, until, tokens, rows in _pieces(unit, raw, at, 2 * threshold + 2048, piece):
                own = (row >= lo) & (row < hi) & (p0 >= skipped) & (p0 < until)
                if not own.any():
                    continue
                found = _ranges(tokens, rows, row[own] - lo, p0[own] - skipped, off[own], more[own], threshold, width)
                found["doc"], found["p0"] = ids[lo:hi][found.pop("row")], found["p0"] + skipped
                held.append(found)
                count += len(found["kh"])
                if count > FLUSH:
                    yield from _settle_task(_taken(held), threshold)
                    count = 0
        if held:
            yield from _settle_task(_taken(held), threshold)

    return texts.mapInArrow(lambda batches: released(run(batches)), FILED)


def _ranges(tokens: np.ndarray, rows: np.ndarray, row: np.ndarray, p0: np.ndarray, off: np.ndarray, more: np.ndarray, threshold: int, width: int) -> dict[str, np.ndarray]:
    """Records of the ranges of ``width`` windows that open records fall into."""
    top, low = off // width, (off - more) // width
    parts = top - low + 1
    r = np.repeat(np.arange(len(p0)), parts)
    k = top[r] - (np.arange(len(r)) - np.repeat(np.cumsum(parts) - parts, parts))
    first, last = np.minimum(off[r], k * width + width - 1), np.maximum((off - more)[r], k * width)
    block = rows[row[r]] + p0[r] + off[r]
    stretch = block - k * width - (width - 1) + threshold
    kh = mix64(Roller(tokens, BASE_BLOCK).slices(block - k * width, stretch) ^ mix64(k.astype(U64)))
    ch = mix64(Roller(tokens, BASE_SPAN).slices(block - first, block - last + threshold) ^ mix64(_shape(first, first - last).astype(U64)))
    return {"kh": kh, "ch": ch, "row": row[r], "p0": p0[r] + off[r] - first, "length": _shape(first, first - last)}


CUT = "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(texts: DataFrame, unit: str, piece: int, keep_digest: bool) -> DataFrame:
    split, _ = UNITS[unit]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches, False, piece):
            ids = batch.column(0)
            raw, at = _inflated(batch.column(1))
            pk, row = _lists(batch.column(3))
            start, length, _ = _unpack(pk)
            row, start, length = _merged(row, start, length)
            if unit == "bytes" or not len(row):
                a, b = at[row] + start, at[row] + start + length
            else:
                _, rows, begins, ends = split(raw, at)
                a, b = begins[rows[row] + start], ends[rows[row] + start + length - 1]
            keep = np.ones(len(raw), bool)
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                keep[x:y] = False
            kept = raw[keep].tobytes()
            n = np.diff(at)
            left = np.add.reduceat(np.append(keep, False), at[:-1], dtype=np.int64) * (n > 0)
            k_at = np.concatenate([[0], np.cumsum(left)]).tolist()
            texts_out = [kept[x:y] for x, y in zip(k_at[:-1], k_at[1:], strict=True)]
            spans = np.bincount(row, minlength=len(n))
            sha = [hashlib.sha256(x).hexdigest() for x in texts_out]
            arrays = [ids, pa.array(n), pa.array(n - left), pa.array(spans.astype(np.int64)), pa.array(sha), pa.array(texts_out, pa.binary())]
            if keep_digest:
                whole = raw.tobytes()
                digests = [hashlib.sha256(whole[x:y]).hexdigest() for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                arrays.append(pa.array(digests, pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = CUT + (", digest string" if keep_digest else "")
    names = [c.split()[0] for c in schema.split(", ")]
    return texts.mapInArrow(lambda batches: released(run(batches)), schema)


def text_digest(text):
    """SHA-256 of a text column, of an empty text for null."""
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame | None]:
    """``(doc, text)`` with one row for each doc; also ``(rid, rdigest, doc)`` if ids had to be replaced.

    Replaced ids are positions of a range partitioning by id and digest: they keep the order, and no task numbers all rows.
    """
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    unsure = base.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1 or id is null").limit(1)
    if unsure.isEmpty():
        return base.select(F.col("id").alias("doc"), "text"), None
    pairs = base.select(F.col("id").alias("rid"), text_digest(F.col("text")).alias("rdigest")).distinct()
    order = (F.col("rid").asc_nulls_last(), F.col("rdigest"))
    ranked = stored(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("doc", F.monotonically_increasing_id()), "suffix-ranks")
    texts = base.withColumn("digest", text_digest(F.col("text"))).join(ranked, F.expr("id <=> rid and digest = rdigest"))
    return texts.groupBy("doc").agg(F.first("text").alias("text")), ranked


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "bytes", threshold: int = 100, piece: int = PIECE, keep_digest: bool = False) -> DataFrame:
    """Texts without the tokens covered by a window of ``threshold`` tokens that also starts earlier.

    Earlier: in a smaller id, or in the same text at an earlier start; overlaps count, windows never
    cross texts and are judged on the input. ``unit`` is "bytes" (of UTF-8) or "words". Returns
    ``(id, n_bytes, n_removed, n_spans, kept_sha256, kept binary[, digest])`` for every row: n_spans counts the
    maximal runs removed, kept are the bytes left, digest is the SHA-256 of the input text. Null texts read as empty; rows of one id
    are ordered by their texts' SHA-256, null ids come last, equal rows are one text and all come back
    alike; other columns are not looked at; an empty table gives an empty result. A task hashes ``piece``
    bytes or tokens at once, of a longer text in overlapping pieces; texts may be of any length.
    """
    base, ranked = _keyed(docs, id_col, text_col)
    reach = threshold - UNITS[unit][1] + 1
    if not 1 < reach < 1024:
        raise ValueError(f"threshold must exceed the block of {UNITS[unit][1]} {unit} and stay within 1023 of it")
    packed = _squeezed(base)

    def marked(settled: DataFrame) -> DataFrame:
        # the same left join each time, so that one exchange of the texts serves all passes
        return packed.join(settled.groupBy("doc").agg(F.collect_list("pk").alias("marks")), "doc", "left").select("doc", "z", "size", "marks")

    settled = settle_spans(file_documents(base, unit, threshold, piece), threshold)
    for width in (-(-reach // 4), 1):
        settled = settle_spans(file_again(marked(settled), unit, threshold, width, piece), threshold)
    out = _cut(marked(settled), unit, piece, keep_digest)
    if ranked is None:
        return out.withColumnRenamed("doc", "id")
    # every row comes back, repeats too: they are counted by partition, and expanded after the cut
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_digest(F.col(f"`{text_col}`")).alias("digest"), F.spark_partition_id().alias("part"))
    every = every.groupBy("id", "digest", "part").agg(F.count("*").alias("copies"))
    named = ranked.join(every, F.expr("id <=> rid and digest = rdigest")).select("doc", "id", "copies")
    return named.join(out, "doc").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("doc", "copies", "copy")


def query(spark, sf_dir: str) -> DataFrame:
    cut = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


#: Every window of 100 bytes as hex digits, compared as it is.
SQL = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
w as (select doc_id, p, substr(h, 2 * p + 1, 200) s from (select doc_id, h, unnest(range(0, len(h) // 2 - 99)) p from d where len(h) >= 200)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by s order by doc_id, p) n from w) where n > 1),
runs as (select doc_id, p, sum(new) over (partition by doc_id order by p) run from (
  select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end new from again)),
spans as (select doc_id, run, min(p) a, max(p) + 100 b from runs group by all),
cut as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) before from spans),
left_over as (select c.doc_id, sum(b - a)::bigint n_removed, count(*) n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' order by a) || substr(any_value(h), 2 * max(b) + 1) kept from cut c join d using (doc_id) group by c.doc_id)
select d.doc_id, len(h) // 2 as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256
from d left join left_over using (doc_id)"""
