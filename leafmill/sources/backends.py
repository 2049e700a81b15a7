"""Page sources: what turns a file's bytes into pages, by format, with errors kept as rows.

A backend is a small class; files are spread over tasks by Spark and each is opened where it is read. A file
or page that a backend cannot read becomes a row with an error, and never ends the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame

WIDTH, HEIGHT, LINES, PITCH = 612.0, 792.0, 40, 16.0


class Page(NamedTuple):
    width: float
    height: float
    #: (text, l, t, r, b) of each cell, origin top left
    cells: list[tuple[str, float, float, float, float]]
    #: (l, t, r, b) of each bitmap
    bitmaps: list[tuple[float, float, float, float]]


class Backend:
    """One opened file. ``paginated`` backends give pages; others would give items themselves."""

    paginated = True

    def __init__(self, content: bytes, options: dict[str, str]):
        self.content, self.options = content, options

    def page_count(self) -> int:
        raise NotImplementedError

    def page(self, number: int) -> Page:
        """Page ``number``, from one."""
        raise NotImplementedError


class TextBackend(Backend):
    """Plain text: forty lines a page, a cell for each line that is not blank."""

    def __init__(self, content: bytes, options: dict[str, str]):
        super().__init__(content, options)
        self.lines = content.decode(options.get("encoding", "utf-8")).split("\n")

    def page_count(self) -> int:
        return -(-len(self.lines) // LINES)

    def page(self, number: int) -> Page:
        own = self.lines[(number - 1) * LINES : number * LINES]
        rows = [(x, 72.0, 72 + PITCH * k, 72.0 + min(468, 5 * len(x)), 84 + PITCH * k) for k, x in enumerate(own) if x.strip()]
        return Page(WIDTH, HEIGHT, rows, [])


class ImageBackend(Backend):
    """PNG, JPEG, BMP, and every frame of a GIF or TIFF: no cells, one bitmap over the whole page."""

    def __init__(self, content: bytes, options: dict[str, str]):
        super().__init__(content, options)
        self.frames = frame_sizes(content)
        if not self.frames:
            raise ValueError("no image frame found")

    def page_count(self) -> int:
        return len(self.frames)

    def page(self, number: int) -> Page:
        width, height = map(float, self.frames[number - 1])
        return Page(width, height, [], [(0.0, 0.0, width, height)])


def frame_sizes(content: bytes) -> list[tuple[int, int]]:
    """Width and height of each frame, from the headers."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return [struct.unpack(">II", content[16:24])]
    if content[:2] == b"BM" and len(content) >= 26:
        width, height = struct.unpack("<ii", content[18:26])
        return [(width, abs(height))]
    if content[:4] in (b"II*\0", b"MM\0*"):
        return _tiff_sizes(content)
    if content[:4] == b"GIF8":
        return _gif_sizes(content)
    at = 2
    while content[:2] == b"\xff\xd8" and at + 9 <= len(content) and content[at] == 0xFF:
        # start-of-frame markers are C0 to CF but for C4, C8 and CC
        if 0xC0 <= content[at + 1] <= 0xCF and content[at + 1] not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", content[at + 5 : at + 9])
            return [(width, height)]
        at += 2 + struct.unpack(">H", content[at + 2 : at + 4])[0]
    return []


def _tiff_sizes(content: bytes) -> list[tuple[int, int]]:
    order = "<" if content[:2] == b"II" else ">"
    sizes, seen, at = [], set(), struct.unpack(order + "I", content[4:8])[0]
    while at and at not in seen and at + 2 <= len(content):
        seen.add(at)
        (n,) = struct.unpack(order + "H", content[at : at + 2])
        tags = {}
        for k in range(n):
            tag, kind, _, raw = struct.unpack(order + "HHI4s", content[at + 2 + 12 * k : at + 14 + 12 * k])
            if tag in (256, 257):
                tags[tag] = struct.unpack(order + ("H" if kind == 3 else "I"), raw[: 2 if kind == 3 else 4])[0]
        if len(tags) == 2:
            sizes.append((tags[256], tags[257]))
        (at,) = struct.unpack(order + "I", content[at + 2 + 12 * n : at + 6 + 12 * n])
    return sizes


def _gif_sizes(content: bytes) -> list[tuple[int, int]]:
    width, height, flags = struct.unpack("<HHB", content[6:11])
    at = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    frames = 0

    def past_blocks(at: int) -> int:
        while content[at]:
            at += content[at] + 1
        return at + 1

    while at < len(content) and content[at] != 0x3B:
        if content[at] == 0x21:
            at = past_blocks(at + 2)
        elif content[at] == 0x2C:
            local = content[at + 9]
            at = past_blocks(at + 10 + (3 << (local & 7) + 1 if local & 128 else 0) + 1)
            frames += 1
        else:
            raise ValueError(f"broken GIF at byte {at}")
    return [(width, height)] * frames


_backends: dict[str, type[Backend]] = {"md": TextBackend, "csv": TextBackend, "image": ImageBackend}


def register_backend(fmt: str, backend: type[Backend]) -> None:
    """Use ``backend`` for a format. A second one for a format is an error."""
    if fmt in _backends:
        raise ValueError(f"a backend for {fmt} is registered already")
    _backends[fmt] = backend


def known(fmt: str | None) -> type[Backend] | None:
    """The backend of a format, or None."""
    if "pdf" not in _backends:
        import leafmill.sources.pdf

        _backends["pdf"] = leafmill.sources.pdf.PdfBackend
    return _backends.get(fmt)


def backend_of(fmt: str | None) -> type[Backend]:
    own = known(fmt)
    if own is None:
        raise ValueError(f"no backend for format {fmt}")
    return own


PAGES = "file string, page_no int, width double, height double, error string, cells array<struct<idx:int,text:string,l:double,t:double,r:double,b:double>>, bitmaps array<struct<rect_id:int,l:double,t:double,r:double,b:double>>"


def read_pages(files: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Pages of ``(file, format, content)``: ``(file, page_no, width, height, error, cells, bitmaps)``.

    A file that cannot be opened, or whose format has no backend, is one row without a page number; a page
    that cannot be loaded has an error and no size.
    """
    known(None)
    chosen, own = dict(_backends), options or {}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for name, fmt, content in zip(batch["file"], batch["format"], batch["content"], strict=True) for r in rows_of(name, chosen.get(fmt), fmt, content, own)]
            yield pd.DataFrame(rows, columns=["file", "page_no", "width", "height", "error", "cells", "bitmaps"]).astype({"page_no": "Int32"})

    return files.select("file", "format", "content").mapInPandas(run, PAGES)


def rows_of(name: str, backend: type[Backend] | None, fmt: str | None, content: bytes | None, options: dict[str, str], first: int = 1, last: int | None = None) -> Iterator[tuple]:
    """Rows of the pages of one file, from ``first`` to ``last``."""
    try:
        if backend is None:
            raise ValueError(f"no backend for format {fmt}")
        opened = backend(bytes(content or b""), options)
        count = opened.page_count()
    except Exception as e:  # whatever a parser raises belongs to this file
        yield name, None, None, None, f"{type(e).__name__}: {e}", None, None
        return
    for number in range(first, count + 1 if last is None else min(count, last) + 1):
        try:
            page = opened.page(number)
            cells = [{"idx": k, "text": x[0], "l": x[1], "t": x[2], "r": x[3], "b": x[4]} for k, x in enumerate(page.cells)]
            bitmaps = [{"rect_id": k, "l": x[0], "t": x[1], "r": x[2], "b": x[3]} for k, x in enumerate(page.bitmaps)]
            yield name, number, page.width, page.height, None, cells, bitmaps
        except Exception as e:
            yield name, number, None, None, f"{type(e).__name__}: {e}", None, None
