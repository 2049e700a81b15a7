import hashlib
import importlib.metadata
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.config import Options, TableOptions
from leafmill.plans import archives, engine
from leafmill.plans.engine import Engine


@pytest.fixture(scope="module")
def made(spark):
    rows = [(1, "a.md", bytearray("First line\n\nSecond – line".encode())), (2, "b.md", bytearray(b"")), (3, "c.pdf", bytearray(b"no pdf"))]
    return Engine(Options(raises_on_error=False)).convert_streams(spark.createDataFrame(rows, "doc_id long, name string, content binary"), "content", "name")


def test_archives_are_written_and_loaded(spark, made, tmp_path):
    archives.save_archives(made, f"{tmp_path}/out")
    archives.save_archives(made, f"{tmp_path}/out")
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["1.zip", "2.zip", "3.zip"]
    with zipfile.ZipFile(tmp_path / "out" / "1.zip") as z:
        assert set(z.namelist()) == {f"{name}.json" for name in archives.PARTS} and z.testzip() is None
        assert [x["text"] for x in json.loads(z.read("document.json"))] == ["First line", "Second – line"]
    files = spark.read.format("binaryFile").load(f"{tmp_path}/out/*.zip").select("path", "content")
    back = {r.path[-5]: r for r in archives.load_archives(files).collect()}
    want = {str(r.doc_id): r.status for r in made.results.collect()}
    assert {k: r.status for k, r in back.items()} == want and all(r.error is None for r in back.values())
    assert back["1"].origin.filename == "a.md" and back["1"].origin.binary_hash == hashlib.sha256("First line\n\nSecond – line".encode()).hexdigest()
    assert back["1"].pages[0].page_no == 1 and back["3"].status == "failure"


def test_missing_and_broken_members(spark):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("status.json", '"success"')
        z.writestr("errors.json", "{no json")
        z.writestr("pages.json", '"not a list"')
        z.writestr("more.json", "1")
    files = spark.createDataFrame([("a", bytearray(out.getvalue())), ("b", bytearray(b"no zip")), ("c", None), (None, bytearray(out.getvalue()[:40]))], "path string, content binary")
    got = {r.path: r for r in archives.load_archives(files).collect()}
    assert got["a"].status == "success" and got["a"].errors is None and got["a"].pages is None and got["a"].version is None and got["a"].error is None
    assert all(got[k].error and got[k].status is None for k in ("b", "c", None))
    assert archives.load_archives(files.limit(0)).count() == 0


def test_equal_documents_have_equal_archives():
    assert archives.packed('{"status": "x"}') == archives.packed('{"status": "x"}')
    assert json.loads(archives.unpacked(archives.packed('{"status": "x", "document": [{"text": "é"}]}')))["document"] == [{"text": "é"}]


def offered():
    return [("table", TableOptions, len), ("figure", Options, len)]


def test_entry_points_are_refused_or_loaded(monkeypatch):
    point = lambda name, value: importlib.metadata.EntryPoint(name, value, "leafmill.stages")
    points = [point("theirs", f"{__name__}:offered"), point("lost", "no_such_package_here:f")]
    monkeypatch.setattr(importlib.metadata, "entry_points", lambda group: points if group == "leafmill.stages" else [])
    monkeypatch.setattr(engine, "_stages", {("figure", Options): max})
    assert engine.load_stages() == {"theirs": "refused", "lost": "refused"} and engine._stages == {("figure", Options): max}
    points.pop()
    assert engine.load_stages(allow_external=True) == {"theirs": "in part"}
    assert engine._stages == {("figure", Options): max, ("table", TableOptions): len}
