import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.config import Options
from leafmill.plans.engine import Engine
from leafmill.sources import pixels

RNG = np.random.default_rng(5)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.sampled_from([1, 2, 3, 4]), st.randoms(use_true_random=False))
def test_png_round_trip(height, width, channels, random):
    rng = np.random.default_rng(random.getrandbits(32))
    own = rng.integers(0, 256, (height, width, channels), dtype=np.uint8)
    for kinds in (0, 1, 2, 3, 4, rng.integers(0, 5, height), rng.integers(0, 3, height)):
        assert (pixels.decode(pixels.encode(own, 72, kinds)) == own).all()


@pytest.mark.parametrize("diagonal", [0, 1 << 40])
def test_both_ways_of_undoing_filters(monkeypatch, diagonal):
    monkeypatch.setattr(pixels, "DIAGONAL", diagonal)
    for channels in (1, 3):
        own = RNG.integers(0, 256, (40, 33, channels), dtype=np.uint8)
        assert all((pixels.decode(pixels.encode(own, kinds=k)) == own).all() for k in (3, 4, np.arange(40) % 5))


def chunked(*parts):
    return pixels.SIGNATURE + b"".join(struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d)) for k, d in parts)


def test_a_filtered_row_known_by_hand():
    # rows 10 20 30 / 15 27 41: paeth guesses 10, 20, 30 for the second row
    rows = bytes([1, 10, 10, 10, 4, 5, 7, 11])
    head = struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)
    assert pixels.decode(chunked((b"IHDR", head), (b"IDAT", zlib.compress(rows)), (b"IEND", b"")))[:, :, 0].tolist() == [[10, 20, 30], [15, 27, 41]]


def test_palettes_and_small_and_large_depths():
    head = lambda w, h, depth, colour, laced=0: (b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, laced))
    data = lambda *rows: (b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows)))
    bits = pixels.decode(chunked(head(3, 2, 1, 0), data([0b10100000], [0b01000000])))
    assert bits[:, :, 0].tolist() == [[255, 0, 255], [0, 255, 0]]
    coloured = pixels.decode(chunked(head(3, 1, 4, 3), (b"PLTE", bytes([1, 2, 3, 4, 5, 6])), data([0x01, 0x10])))
    assert coloured.tolist() == [[[1, 2, 3], [4, 5, 6], [4, 5, 6]]]
    assert pixels.decode(chunked(head(2, 1, 16, 0), data([7, 99, 8, 98])))[:, :, 0].tolist() == [[7, 8]]
    for bad in (chunked(head(3, 1, 4, 3), (b"PLTE", bytes([1, 2, 3])), data([0x01, 0x10])), chunked(head(2, 1, 8, 0, 1), data([7, 9])), chunked(head(2, 2, 8, 0), data([7, 9])), chunked(head(2**20, 2**20, 8, 0), data([7, 9])), chunked(data([1])), b"\xff\xd8\xff", b""):
        with pytest.raises(ValueError):
            pixels.decode(bad)


def bmp(own, depth=24, down=False):
    height, width, _ = own.shape
    rows = own[:, :, ::-1] if depth == 24 else own[:, :, :1]
    lines = b"".join((r.tobytes() + b"\0\0\0")[: (width * depth // 8 + 3) // 4 * 4] for r in (rows if down else rows[::-1]))
    table = b"".join(bytes([k, k, k, 0]) for k in range(256)) if depth == 8 else b""
    return b"BM" + struct.pack("<IIIIiiHHIIIIII", 0, 0, 54 + len(table), 40, width, -height if down else height, 1, depth, 0, 0, 0, 0, 0, 0) + table + lines


def tiff(*frames, order="<", strips=2):
    out = bytearray((b"II*\0" if order == "<" else b"MM\0*") + b"\0\0\0\0")
    link = 4
    for own in frames:
        height, width, channels = own.shape
        per = -(-height // strips)
        parts = [own[k : k + per].tobytes() for k in range(0, height, per)]
        places = []
        for p in parts:
            places.append(len(out))
            out += p
        outside = {258: (8,) * channels, 273: places, 279: [len(p) for p in parts]}
        tags = [(256, 4, [width]), (257, 4, [height]), (258, 3, outside[258]), (259, 3, [1]), (262, 3, [2 if channels == 3 else 1]), (273, 4, places), (277, 3, [channels]), (278, 4, [per]), (279, 4, outside[279])]
        entries = b""
        for tag, kind, values in tags:
            raw = struct.pack(f"{order}{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                where, raw = len(out), raw
                out += raw
                raw = struct.pack(order + "I", where)
            entries += struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
        out[link : link + 4] = struct.pack(order + "I", len(out))
        out += struct.pack(order + "H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def test_bmp_and_tiff():
    own = RNG.integers(0, 256, (5, 7, 3), dtype=np.uint8)
    grey = RNG.integers(0, 256, (4, 3, 1), dtype=np.uint8)
    assert all((pixels.decode(bmp(own, down=d)) == own).all() for d in (False, True))
    assert (pixels.decode(bmp(grey, 8)) == np.repeat(grey, 3, axis=2)).all()
    for order in "<>":
        both = tiff(own, grey, order=order)
        assert (pixels.decode(both) == own).all() and (pixels.decode(both, 2) == grey).all()
        with pytest.raises(ValueError, match="no frame"):
            pixels.decode(both, 3)


def test_cutting_and_scaling():
    own = RNG.integers(0, 256, (6, 8, 3), dtype=np.uint8)
    assert (pixels.cut(own, (1, 2, 5, 4), (8, 6)) == own[2:4, 1:5]).all()
    assert (pixels.cut(own, (1, 2, 5, 4), (8, 6), 2.0) == own[2:4, 1:5].repeat(2, axis=0).repeat(2, axis=1)).all()
    halves = own.reshape(3, 2, 4, 2, 3).mean(axis=(1, 3))
    assert (pixels.cut(own, (0, 0, 8, 6), (8, 6), 0.5) == np.rint(halves)).all()
    assert (pixels.cut(own, (0, 0, 2, 3), (4, 3)) == np.rint(halves[:, :2])).all()
    assert pixels.cut(own, (-9, -9, 99, 99), (8, 6)).shape == own.shape
    with pytest.raises(ValueError, match="nothing of the box"):
        pixels.cut(own, (9, 9, 12, 12), (8, 6))


def test_pictures_of_what_was_converted(spark):
    page = RNG.integers(0, 256, (300, 200, 3), dtype=np.uint8)
    many = tiff(page, page[::-1].copy())
    rows = [(1, "a.png", pixels.encode(page, kinds=4)), (2, "b.tiff", many), (3, "c.png", pixels.encode(page)[:200])]
    files = spark.createDataFrame([(d, n, bytearray(c)) for d, n, c in rows], "doc_id long, name string, content binary")
    inputs = spark.createDataFrame([(1, "a.png", 9, 1), (2, "b.tiff", 9, 2), (3, "c.png", 9, 1)], "doc_id long, file string, filesize long, page_count int")
    pages = spark.createDataFrame([(d, p, 200.0, 300.0, True) for d, p in ((1, 1), (2, 1), (2, 2), (3, 1))], "doc_id long, page_no int, width double, height double, backend_ok boolean")
    cells = spark.createDataFrame([], "doc_id long, page_no int, idx int, text string, l double, t double, r double, b double, from_ocr boolean, conf double")
    dets = spark.createDataFrame([(d, p, 0, "picture", 10.0, 20.0, 110.0, 100.0, 0.9) for d, p in ((1, 1), (2, 1), (2, 2), (3, 1))] + [(1, 1, 1, "table", 20.0, 150.0, 190.0, 290.0, 0.9)], "doc_id long, page_no int, id int, label string, l double, t double, r double, b double, conf double")
    wants = Options(images_scale=2.0, page_images=True, table_images=True, raises_on_error=False)
    made = Engine(wants).convert_all(inputs, cells, dets, pages)
    got = {(r.doc_id, r.page_no, r.item_ref): r for r in Engine(wants).images(made, files).collect()}
    assert len(got) == 9 and all(r.dpi == 144 for k, r in got.items() if k[0] < 3)
    double = lambda x: x.repeat(2, axis=0).repeat(2, axis=1)
    assert (pixels.decode(got[1, 1, "#/1/0"].png) == double(page[20:100, 10:110])).all()
    assert (pixels.decode(got[1, 1, "#/1/1"].png) == double(page[150:290, 20:190])).all()
    assert (pixels.decode(got[2, 2, "#/2/0"].png) == double(page[::-1][20:100, 10:110])).all()
    assert (pixels.decode(got[2, 1, None].png) == double(page)).all()
    assert got[3, 1, "#/1/0"].png is None and got[3, 1, "#/1/0"].error
    only = Engine(Options(raises_on_error=False)).images(made, files.filter("doc_id <> 2")).collect()
    assert sorted((r.doc_id, r.item_ref, r.error is None) for r in only) == [(1, "#/1/0", True), (2, "#/1/0", False), (2, "#/2/0", False), (3, "#/1/0", False)]
