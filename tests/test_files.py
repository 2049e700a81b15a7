"""From files to results: PDF parsing, page ranges, pushed filters, errors as rows."""

from __future__ import annotations

import struct
import zlib

import pytest

from leafmill.config import Limits, Options
from leafmill.plans.engine import Engine
from leafmill.sources import page_source
from leafmill.sources.pdf import PdfBackend, PdfFile, Reader, lines, unicode_map, written


def png(width: int, height: int) -> bytes:
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBBBBB", 13, b"IHDR", width, height, 8, 2, 0, 0, 0) + b"\0\0\0\0"


PAGES = [[("Title of it", 72.0, 100.0), ("first line", 72.0, 130.0), ("second – line €𝄞", 72.0, 142.0)], [], [("(a) \\ b", 30.0, 700.0)]]


@pytest.mark.parametrize("packed", [True, False])
def test_pages_come_back(packed):
    own = PdfBackend(written(PAGES, packed=packed), {})
    assert own.page_count() == 3
    for number, page in enumerate(PAGES, 1):
        got = own.page(number)
        assert (got.width, got.height) == (612, 792)
        assert got.cells == [(text, left, base - 8, left + 6 * len(text), base + 2) for text, left, base in page]


@pytest.mark.parametrize("packed", [True, False])
def test_broken_cross_references_are_searched(packed):
    whole = written(PAGES, packed=packed)
    for broken in (whole.replace(b"startxref\n", b"startxref\n9"), whole[: whole.rindex(b"startxref")], b"%PDF-1.4\njunk" + whole):
        own = PdfBackend(broken, {})
        assert [c[0] for c in own.page(1).cells] == [x[0] for x in PAGES[0]]
    for hopeless in (b"", b"no", b"%PDF-1.4", whole[:200]):
        with pytest.raises((ValueError, TypeError)):
            PdfBackend(hopeless, {})


def document(content: bytes, resources: str, more: dict[int, bytes] | None = None, page: str = "") -> PdfBackend:
    objects = {1: b"<</Type/Catalog/Pages 2 0 R>>", 2: b"<</Kids[3 0 R]/Count 1>>", 3: f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 200 100]/Contents 4 0 R/Resources<<{resources}>>{page}>>".encode(), 4: b"<</Length %d>>stream\n%s\nendstream" % (len(content), content)} | (more or {})
    return PdfBackend(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in objects.items()) + b"trailer <</Root 1 0 R>>", {})


FONT = "/Font<</F<</Subtype/Type1/BaseFont/X/FirstChar 65/Widths[500 700]/Encoding<</BaseEncoding/MacRomanEncoding/Differences[66/eacute/uni20AC]>>>>>>"


def test_text_operators():
    own = document(b"BT /F 10 Tf 12 TL 10 80 Td [(A)-600(AA)50(A)] TJ T* (B\\103) Tj 2 0 0 2 100 50 Tm 50 Tz (AA) Tj ET", FONT).page(1)
    texts = [(c[0], round(c[1], 3), round(c[3], 3)) for c in own.cells]
    assert texts == [("A AAA", 10.0, 35.5), ("é€", 10.0, 22.0), ("AA", 100.0, 110.0)]


def test_forms_images_and_turned_pages():
    image = b"<</Subtype/Image/Width 2/Height 2/Length 0>>stream\n\nendstream"
    form = b"<</Subtype/Form/Matrix[1 0 0 1 5 5]/Length 43>>stream\nBT /F 10 Tf (A) Tj ET q 20 0 0 10 1 2 cm /I Do Q\nendstream"
    resources = FONT + "/XObject<</P 5 0 R/I 6 0 R>>"
    content = b"/P Do q 50 0 0 40 100 10 cm BI /W 1 /H 1 ID \x00\x01 EI Q"
    own = document(content, resources, {5: form, 6: image}).page(1)
    assert own.cells == [("A", 5.0, 87.0, 10.0, 97.0)] and own.bitmaps == [(6.0, 83.0, 26.0, 93.0), (100.0, 50.0, 150.0, 90.0)]
    turned = document(content, resources, {5: form, 6: image}, "/Rotate 90").page(1)
    assert (turned.width, turned.height) == (100, 200) and turned.bitmaps[1] == (10.0, 100.0, 50.0, 150.0)


def test_filters_and_predictors():
    body = b"BT /F 10 Tf 10 50 Td (A) Tj ET"
    rows = b"".join(bytes([1]) + bytes([row[0]]) + bytes((b - a) & 255 for a, b in zip(row, row[1:], strict=False)) for row in (body[k : k + 10] for k in range(0, 30, 10)))
    packed = zlib.compress(rows).hex().encode() + b">"
    stream = b"<</Length %d/Filter[/AHx/Fl]/DecodeParms[null<</Predictor 15/Columns 10>>]>>stream\n%s\nendstream" % (len(packed), packed)
    assert document(b"", FONT, {4: stream}).page(1).cells[0][0] == "A"
    with pytest.raises(ValueError, match="filter DCTDecode"):
        document(b"", FONT, {4: stream.replace(b"/Fl]", b"/DCTDecode]")}).page(1)
    with pytest.raises(ValueError, match="encrypted"):
        PdfFile(b"%PDF-1.4\n1 0 obj<</Type/Catalog/Pages 2 0 R>>endobj 2 0 obj<</Kids[]>>endobj trailer <</Root 1 0 R/Encrypt 3 0 R>>")


def test_objects_and_maps():
    assert Reader(b"[/A#42 (a(b)\\)\\n\\101\\\nz) <4 1 4> 1 0 R -.5 true null % x\n<</K 3>>]").object() == ["AB", b"a(b))\nAz", b"A@", (1, 0), -0.5, True, None, {"K": 3}]
    texts, lengths = unicode_map(b"1 begincodespacerange <00> <FF> endcodespacerange 2 beginbfrange <10> <12> <0041> <20> <21> [<0066006C> <D834DD1E>] endbfrange 1 beginbfchar <01> <00DF> endbfchar")
    assert lengths == {1} and texts == {b"\x10": "A", b"\x11": "B", b"\x12": "C", b"\x20": "fl", b"\x21": "𝄞", b"\x01": "ß"}
    assert [x[0] for x in lines([("a", 0, 0, 10, 10, 2, 10), ("b", 11, 0, 20, 10, 2, 10), ("c", 25, 0, 30, 10, 2, 10), ("d", 60, 0, 70, 10, 2, 10), ("e", 60, 20, 70, 30, 22, 10)])] == ["ab c", "d", "e"]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    where = tmp_path_factory.mktemp("files")
    (where / "a.pdf").write_bytes(written(PAGES))
    (where / "long.pdf").write_bytes(written([[(f"page {k} " + "x" * 60, 72.0, 100.0 + 12 * n) for n in range(50)] for k in range(1, 31)], packed=False) + b"\n%" + b" " * (1 << 20))
    (where / "bad.pdf").write_bytes(b"%PDF-1.4 nothing")
    (where / "note.md").write_text("Hello there\n\n- one\n- two\n\nlast words\n")
    (where / "deep").mkdir()
    (where / "deep" / "p.png").write_bytes(png(30, 20))
    (where / "what.xyz").write_bytes(b"?")
    return where


def test_convert_files(spark, folder):
    made = Engine(Options(limits=Limits(max_num_pages=20))).convert_files(spark, str(folder))
    got = {r.file: r for r in made.results.collect()}
    assert {n: (r.status, r.page_count) for n, r in got.items()} == {
        "a.pdf": ("success", 3), "long.pdf": ("failure", 30), "bad.pdf": ("failure", None), "note.md": ("success", 1), "p.png": ("success", 1), "what.xyz": ("failure", None),
    }
    assert got["long.pdf"].reason == "too many pages" and "no catalog" in got["bad.pdf"].open_error and got["a.pdf"].mime == "application/pdf"
    names = {r.doc_id: n for n, r in got.items()}
    items: dict = {}
    for r in made.items.orderBy("doc_id", "seq").collect():
        items.setdefault(names[r.doc_id], []).append((r.type, r.text))
    assert items["note.md"] == [("text", "Hello there"), ("list_item", "one"), ("list_item", "two"), ("text", "last words")]
    assert items["a.pdf"] == [("text", "Title of it"), ("text", "first line second – line €𝄞"), ("text", "(a) \\ b")]
    assert [r.t for r in made.regions.collect()] == [0.0]


def test_page_source_by_ranges(spark, folder):
    page_source.register(spark)
    source = spark.read.format("leafmill_pages").option("pagesPerPartition", 7)
    every = source.load(str(folder))
    rows = every.select("file", "page_no", "error", "cells").collect()
    assert sorted(r.page_no for r in rows if r.file == "long.pdf") == list(range(1, 31))
    assert {r.file: r.error.split(":")[0] for r in rows if r.error} == {"bad.pdf": "ValueError", "what.xyz": "ValueError"}
    long = every.filter("file = 'long.pdf' and page_no > 12 and page_no <= 20")
    assert [r.cells[0].text[:7] for r in long.orderBy("page_no").collect()] == [f"page {k}" for k in range(13, 21)]
    assert long.rdd.getNumPartitions() == 2  # of files and page ranges, only those asked for
    assert every.filter("page_no >= 1").filter("file in ('bad.pdf', 'a.pdf')").count() == 3
    assert source.load(str(folder / "none")).count() == 0
    assert every.filter("file = 'a.pdf' and width > 600").count() == 3


def test_a_line_is_shown_without_a_call_for_each_character():
    import sys

    from leafmill.sources import backends, pdf

    text = "abc äöü " * 2500
    content, calls = pdf.written([[(text, 72.0, 80.0)]]), []
    sys.setprofile(lambda frame, event, arg: calls.append(event))
    try:
        (row,) = backends.rows_of("a", pdf.PdfBackend, "pdf", content, {})
    finally:
        sys.setprofile(None)
    assert [(c["text"], c["r"]) for c in row[5]] == [(text.strip(), 72 + 6.0 * len(text))]
    assert len(calls) < len(text) / 2


def test_white_space_before_an_object_is_tried_once():
    from leafmill.sources.pdf import Reader

    assert Reader(b" \n" * 5000 + b"% x\n" * 500 + b"[<4 1> /a#20b (c(d)\\051)]").object() == [b"A", "a b", b"c(d))"]


def test_contents_are_not_made_again_for_results(spark):
    from leafmill.plans import plugins
    from leafmill.plans.engine import Engine

    docs = spark.createDataFrame([(1, "one\ntwo"), (2, None)], "doc_id long, text string")
    out = Engine().convert_streams(plugins.pdf_documents(docs), "content", "name").results
    assert "MapInArrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.status, r.page_count) for r in out.collect()) == [(1, "success", 1), (2, "success", 1)]
