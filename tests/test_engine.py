import struct

import pytest
from pyspark.sql import functions as F

from leafmill.config import EnrichmentOptions, FigureOptions, Limits, OcrOptions, Options, TableOptions, preset
from leafmill.plans import engine, plugins, resources
from leafmill.sources import backends, formats
from leafmill.sources import text_pages as tp

OPTIONS = Options(limits=Limits(max_num_pages=2), allowed_formats=("pdf", "html", "md", "image", "docx", "pptx"), raises_on_error=False)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 24")
    cells = tp.cells(docs)
    return tp.admission(docs), cells, tp.detections(cells), tp.page_dim(cells)


def test_save_and_load(spark, tables, tmp_path):
    made = engine.Engine(OPTIONS).convert_all(*tables)
    results = {r.doc_id: r for r in made.results.collect()}
    assert len(results) == tables[0].count() and all(r.status == "skipped" for r in results.values() if r.file.endswith(".csv"))
    timings = tables[0].select("doc_id", F.lit("layout").alias("key"), F.lit("page").alias("scope"), F.lit(0.5).alias("elapsed"))
    engine.save(made, f"{tmp_path}/saved", timings)
    (tmp_path / "saved" / "more.json").write_text('{"doc_id": 900, "value": "{\\"status\\": \\"success\\"}"}\n{"doc_id": 901, "value": "no json"}\n')
    back = {r.doc_id: r for r in engine.load(spark, f"{tmp_path}/saved").collect()}
    assert {d: r.status for d, r in back.items() if d < 900} == {d: r.status for d, r in results.items()}
    assert back[900].status == "success" and back[900].pages is None and back[901].status is None
    assert all(r.version and r.timings[0].total == 0.5 for d, r in back.items() if d < 900)
    assert any(r.pages for r in back.values()) and any(r.confidence and r.confidence.mean_grade for r in back.values())
    assert {"status", "document"} <= set(__import__("json").loads(next(r.summary for r in engine.summaries(made).collect() if '"document"' in r.summary)))


def test_bad_rows_fail_their_page_only(spark, tables):
    inputs, cells, dets, pages = tables
    good = pages.withColumn("backend_ok", F.lit(True)).withColumn("error", F.when(F.col("doc_id") == 1, "cannot be read"))
    cells = cells.withColumn("l", F.when(F.col("doc_id") == 4, None).otherwise(F.col("l")))
    dets = dets.withColumn("label", F.when(F.col("doc_id") == 6, None).otherwise(F.col("label")))
    got = {r.doc_id: (r.status, r.errors and r.errors[0].error_message) for r in engine.Engine(Options(raises_on_error=False)).convert_all(inputs, cells, dets, good).results.collect()}
    assert got[1] == ("failure", "Page 1: cannot be read") and got[4] == ("failure", "Page 1: cell without text or box")
    assert got[6] == ("failure", "Page 1: detection without label, box or confidence") and got[0] == ("success", None)


def test_timeout_and_raising(tables):
    inputs, cells, dets, pages = tables
    slow = pages.withColumn("backend_ok", F.lit(True)).withColumn("elapsed", F.lit(9.0))
    timed = engine.Engine(Options(document_timeout=5.0, raises_on_error=False)).convert_all(inputs, cells, dets, slow)
    assert {r.status for r in timed.results.filter("status <> 'skipped'").collect()} == {"partial_success"}
    with pytest.raises(RuntimeError, match="doc2.html"):
        bad = pages.withColumn("backend_ok", ~F.col("doc_id").isin(2, 10))
        engine.Engine(Options()).convert_all(inputs.filter("doc_id in (2, 10)"), cells, dets, bad)


def test_registered_stages_run(spark, tables, monkeypatch):
    monkeypatch.setattr(engine, "_stages", {})
    seen = []

    def tables_of(found, cells, options):
        seen.append(options.mode)
        return found.select("doc_id", "page_no", F.col("id").alias("cluster_id"), F.lit(2).cast("long").alias("num_rows"), F.lit(3).cast("long").alias("num_cols"))

    def read(decided, regions, options):
        seen.append(options.engine)
        return decided.filter("ocr_mode = 'full_page'").selectExpr("doc_id", "page_no", "0 idx", "'read' text", "600d l", "1d t", "610d r", "5d b", "true from_ocr", "0.9d conf")

    engine.register_stage("table", TableOptions, tables_of)
    engine.register_stage("figure", FigureOptions, lambda found, options: found.select("doc_id", "page_no", F.col("id").alias("cluster_id"), F.lit("chart").alias("figure_class")))
    engine.register_stage("ocr", OcrOptions, read)
    engine.register_stage("enrichment", EnrichmentOptions, lambda found, options: found.withColumn("enrichment", F.concat("type", F.lit(" "), F.round("l").cast("int").cast("string"))))
    pages = tables[3].withColumn("backend_ok", F.lit(True))
    made = engine.Engine(OPTIONS).convert_all(*tables[:3], pages, tp.bitmaps(pages))
    rows = made.items.collect()
    assert {r.enrichment for r in rows if r.type == "text"} == {None} and all(r.enrichment.startswith(r.type) for r in rows if r.type in EnrichmentOptions().types)
    one = engine.Engine(OPTIONS).convert(2, *tables[:3], pages, bitmaps=tp.bitmaps(pages))
    assert {r.seq for r in one.items.collect()} == {r.seq for r in rows if r.doc_id == 2}
    assert seen == ["auto", "accurate"] * 2 and {(r.num_rows, r.num_cols) for r in rows if r.type == "table"} == {(2, 3)}
    assert {r.figure_class for r in rows if r.type == "figure"} <= {"chart"} and any(r.text.endswith("read") for r in rows)
    with pytest.raises(ValueError):
        engine.Engine(OPTIONS).convert_all(tables[0], tables[1], None, pages)


def test_registry():
    def run(pages):
        return pages

    engine.register_stage("enrichment", OcrOptions, run)
    assert engine.stage_for("enrichment", OcrOptions()) is run
    with pytest.raises(ValueError):
        engine.register_stage("enrichment", OcrOptions, run)
    with pytest.raises(ValueError):
        engine.stage_for("table", OcrOptions())


def test_presets_and_devices():
    assert preset("fast").layout.passes == 1 and preset("scans", document_timeout=3.0).ocr.force_full_page_ocr
    with pytest.raises(ValueError):
        preset("none")
    assert resources.device("auto", ("cpu", "cuda")) == "cuda" and resources.device("cuda:1") == "cpu" and resources.device("cuda:1", ("cuda",)) == "cuda:1"
    for bad in ("tpu", "mps:1", "cuda:x"):
        with pytest.raises(ValueError):
            resources.device(bad)
    assert resources.profile("cuda", 2).taskResources["gpu"].amount == 1


def _tiff(sizes):
    out = b"II*\0" + struct.pack("<I", 8)
    for k, (w, h) in enumerate(sizes):
        after = len(out) + 2 + 24 + 4
        out += struct.pack("<H", 2) + struct.pack("<HHIHH", 256, 3, 1, w, 0) + struct.pack("<HHII", 257, 4, 1, h) + struct.pack("<I", after if k + 1 < len(sizes) else 0)
    return out


def _gif(frames):
    image = b"\x2c" + b"\0" * 8 + b"\0" + b"\x02\x01\x44\0"
    return b"GIF89a" + struct.pack("<HHBBB", 5, 7, 0x80, 0, 0) + b"\0" * 6 + (b"\x21\xf9\x04\0\0\0\0\0" + image) * frames + b"\x3b"


def test_streams_and_kept_engines(spark):
    rows = [("a.PDF", b"x"), ("b.bin", b"%PDF-1.7"), ("c.MD", None), ("d", b"x")]
    got = {r.name: (r.format, r.filesize) for r in formats.from_streams(spark.createDataFrame(rows, "name string, content binary"), "content", "name").collect()}
    assert got == {"a.PDF": ("pdf", 1), "b.bin": ("pdf", 8), "c.MD": ("md", 0), "d": ("xml_uspto", 1)}
    assert engine.engine_for(Options()) is engine.engine_for(Options()) is not engine.engine_for(OPTIONS)


def test_page_sources(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 5, 7)
    files = [("a.png", "image", png), ("b.tif", "image", _tiff([(3, 4), (70000 % 65536, 6)])), ("c.gif", "image", _gif(3)), ("d.md", "md", b"x\n" * 45), ("e.pdf", "pdf", b"%PDF"), ("f.md", "md", b"\xff"), ("g.gif", "image", b"GIF89a"), ("h.png", "image", None)]
    rows = backends.read_pages(spark.createDataFrame(files, "file string, format string, content binary")).collect()
    by = {name: [r for r in rows if r.file == name] for name, _, _ in files}
    assert [(r.width, r.height, len(r.bitmaps)) for r in by["a.png"]] == [(5, 7, 1)]
    assert [(r.page_no, r.width, r.height) for r in by["b.tif"]] == [(1, 3, 4), (2, 4464, 6)] and len(by["c.gif"]) == 3
    assert [(r.page_no, len(r.cells)) for r in by["d.md"]] == [(1, 40), (2, 5)]
    assert all(len(by[n]) == 1 and by[n][0].error and by[n][0].page_no is None for n in ("e.pdf", "f.md", "g.gif", "h.png"))


def test_image_headers():
    assert plugins.image_size(b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + b"\0\0\0\x05\0\0\0\x07") == ("png", 5, 7)
    assert plugins.image_size(b"") is None and plugins.image_size(b"\xff\xd8\xff") is None


@pytest.mark.parametrize("forced", [False, True])
def test_words_and_characters_beside_lines(spark, forced):
    """Texts are made of lines alone; once OCR is forced, only its own words and characters count."""
    inputs = spark.createDataFrame([(1, "a.pdf", 10, 2)], "doc_id long, file string, filesize long, page_count int")
    pages = spark.createDataFrame([(1, k, 100.0, 100.0, True) for k in (1, 2)], "doc_id long, page_no int, width double, height double, backend_ok boolean")
    schema = "doc_id long, page_no int, idx int, text string, l double, t double, r double, b double, from_ocr boolean, conf double, granularity string"
    box = (10.0, 10.0, 60.0, 20.0)
    own = [(1, 1, 0, "two words", *box, False, 1.0, None), (1, 1, 1, "two", *box, False, 1.0, "word"), (1, 1, 2, "words", *box, False, 1.0, "word"), (1, 1, 3, "t", *box, False, 1.0, "char")]
    low = (10.0, 50.0, 60.0, 60.0)
    read = [(1, 1, 0, "seen line", *low, True, 0.9, "line"), (1, 1, 1, "seen", *low, True, 0.9, "word"), (1, 2, 0, "s", *low, True, 0.9, "char")]
    dets = spark.createDataFrame([(1, 1, 0, "text", 5.0, 5.0, 95.0, 95.0, 0.9)], "doc_id long, page_no int, id int, label string, l double, t double, r double, b double, conf double")
    maps = spark.createDataFrame([(1, k, 0, 0.0, 0.0, 100.0, 100.0) for k in (1, 2)], "doc_id long, page_no int, rect_id int, l double, t double, r double, b double")
    made = engine.Engine(Options(ocr=OcrOptions(force_full_page_ocr=forced))).convert_all(inputs, spark.createDataFrame(own, schema), dets, pages, maps, spark.createDataFrame(read, schema))
    flags = {r.page_no: (r.n_lines, r.n_words, r.n_chars, r.has_words, r.has_chars) for r in made.cell_flags.collect()}
    assert flags == {1: (1, 1, 0, True, False) if forced else (2, 3, 1, True, True), 2: (0, 0, 1, False, True)}
    assert [r.text for r in made.items.collect()] == ["seen line" if forced else "two words seen line"]
