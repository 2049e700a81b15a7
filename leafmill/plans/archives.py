"""Saved documents as ZIP archives: one archive a document, one member a part, made and opened in the tasks that hold the rows."""

from __future__ import annotations

import io
import json
import os
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.plans.engine import MEMBERS, Conversion, saved

#: Member of an archive for each part of a saved document.
PARTS = {"timestamp": "saved_at", "version": "version", "origin": "origin", "status": "status", "errors": "errors", "pages": "pages", "timings": "timings", "confidence": "confidence", "document": "document"}
#: Bytes of a member at most, so that a small archive cannot fill a worker's memory.
MOST_BYTES = 1 << 30


def packed(value: str) -> bytes:
    """The archive of one saved document. Members carry a fixed time, so equal documents give equal archives."""
    parts, out = json.loads(value), io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, key in PARTS.items():
            archive.writestr(zipfile.ZipInfo(f"{name}.json"), json.dumps(parts.get(key), ensure_ascii=False), zipfile.ZIP_DEFLATED)
    return out.getvalue()


def unpacked(content: bytes) -> str:
    """A saved document from its archive: members that are missing or hold no JSON are null."""
    parts = {}
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        sizes = {info.filename: info.file_size for info in archive.infolist()}
        for name, key in PARTS.items():
            if sizes.get(f"{name}.json", MOST_BYTES + 1) > MOST_BYTES:
                continue
            try:
                parts[key] = json.loads(archive.read(f"{name}.json").decode())
            except ValueError:
                parts[key] = None
    return json.dumps(parts, ensure_ascii=False)


def archives(conversion: Conversion, timings: DataFrame | None = None) -> DataFrame:
    """``(doc_id, archive)``: each document's archive, to be written to any store as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([packed(batch.column(1)[n].as_py())], pa.binary())], ["doc_id", "archive"])

    return saved(conversion, timings).select(F.col("doc_id").cast("long"), "value").mapInArrow(run, "doc_id long, archive binary")


def save_archives(conversion: Conversion, folder: str, timings: DataFrame | None = None) -> None:
    """Write ``<folder>/<doc_id>.zip`` for each document, in a folder that every executor mounts.

    A file takes its name once it is whole, so a task that runs twice leaves the same files. Documents that share an id share a file.
    """
    os.makedirs(folder, exist_ok=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, archive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = os.path.join(folder, f".{uuid.uuid4().hex}.part")
                with open(part, "wb") as f:
                    f.write(archive)
                os.replace(part, os.path.join(folder, f"{doc_id}.zip"))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["doc_id"])

    archives(conversion, timings).mapInArrow(run, "doc_id long").agg(F.count("*")).collect()


def load_archives(files: DataFrame, schema: str | None = None) -> DataFrame:
    """Saved documents of ``files`` (path, content): ``path``, the members of ``schema`` (default: all but the items), and ``error`` where
    a file is no archive. Members that are missing, or are not of their type, come back null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                value = error = None
                try:
                    value = unpacked(batch.column(1)[n].as_py() or b"")
                except Exception as e:  # whatever a broken file raises belongs to its row
                    error = f"{type(e).__name__}: {e}"
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(n, 1), pa.array([value], pa.string()), pa.array([error], pa.string())], ["path", "value", "error"])

    rows = files.select("path", "content").mapInArrow(run, "path string, value string, error string")
    return rows.select("path", F.from_json("value", schema or MEMBERS, {"mode": "PERMISSIVE"}).alias("r"), "error").select("path", "r.*", "error")
