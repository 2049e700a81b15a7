"""Plug-in surface: batch scorers, table functions and file-header parsers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from leafmill.sources.backends import frame_sizes


def batch_scorer(rows: DataFrame, vector_col: str, centre: list[float]) -> DataFrame:
    """Adds ``score``: cosine to a centre. The iterator form sets a model up once for each worker; null vectors score null."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = np.array(centre)
        c = c / (np.linalg.norm(c) or 1.0)
        for batch in batches:
            there = batch.notna().to_numpy()
            out = np.full(len(batch), np.nan)
            if there.any():
                vectors = np.stack(batch[there].to_numpy()).astype(float)  # the batch as one matrix
                lengths = np.linalg.norm(vectors, axis=1)
                out[there] = vectors @ c / np.where(lengths > 0, lengths, 1.0)
            yield pd.Series(pd.array(out, "Float64"))

    return rows.withColumn("score", score(vector_col))


@F.udtf(returnType="chunk int, part string")
class Chunks:
    """A text in chunks of n characters."""

    def eval(self, text: str, n: int):
        for k in range(0, len(text or ""), n):
            yield k // n, text[k : k + n]


def image_size(content: bytes | None) -> tuple[str, int, int] | None:
    """Kind, width and height of an image's first frame, from its header."""
    found = frame_sizes(content) if content else []
    if not found:
        return None
    kinds = {b"\x89P": "png", b"\xff\xd8": "jpeg", b"BM": "bmp", b"GI": "gif", b"II": "tiff", b"MM": "tiff"}
    return (kinds[content[:2]], *found[0])


def image_pages(files: DataFrame) -> DataFrame:
    """Image files as one-page documents: size from the header, one full-page bitmap, no cells."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [image_size(c) or (None, None, None) for c in batch["content"]]
            yield pd.DataFrame({"file": batch["file"], "kind": [s[0] for s in sizes], "width": pd.array([s[1] for s in sizes], "Int64"), "height": pd.array([s[2] for s in sizes], "Int64")})

    found = files.select("file", "content").mapInPandas(run, "file string, kind string, width long, height long")
    return found.withColumn("valid", F.col("width").isNotNull())


def scored_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batch_scorer(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "embedding", [1.0] * 64).select("vec_id", F.round("score", 6).alias("score"))


def chunked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.udtf.register("leafmill_chunks", Chunks)
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").createOrReplaceTempView("leafmill_benchmark")
    return spark.sql("select b.item_id, cast(c.chunk as bigint) chunk, c.part from leafmill_benchmark b, lateral leafmill_chunks(b.text, 64) c")


def header_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers made from page ids: PNG for even ones, JPEG for odd ones."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    w, h = F.lpad(F.hex(F.col("page_id") % 4000 + 1), 4, "0"), F.lpad(F.hex(F.col("page_id") % 300 + 1), 4, "0")
    png = F.concat(F.lit("89504E470D0A1A0A0000000D494844520000"), w, F.lit("0000"), h)
    jpeg = F.concat(F.lit("FFD8FFE000104A46494600010100000100010000FFC0001108"), h, w)
    content = F.unhex(F.when(F.col("page_id") % 2 == 0, png).otherwise(jpeg))
    return image_pages(pages.select(F.col("page_id").cast("string").alias("file"), content.alias("content")))


CHUNK_SQL = """select item_id, unnest(range((length(text) + 63) // 64)) as chunk, unnest([substr(text, cast(k * 64 + 1 as bigint), 64) for k in range((length(text) + 63) // 64)]) as part from benchmark"""
HEADER_SQL = """select cast(page_id as varchar) as file, case when page_id % 2 = 0 then 'png' else 'jpeg' end as kind, page_id % 4000 + 1 as width, page_id % 300 + 1 as height, true as valid from pages"""
SCORE_SQL = """select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double)) / 8.0 / sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 6) as score from embeddings"""


#: Lines of a page of ``pdf_documents``, and their pitch.
PDF_LINES, PDF_PITCH = 60, 12
#: Bytes of files that ``pdf_documents`` hands on at once.
PDF_BATCH_BYTES = 4 << 20


def pdf_documents(docs: DataFrame) -> DataFrame:
    """``(doc_id, name, content)``: each document's lines as a PDF, every other one without compression; null texts have one empty page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.sources.pdf import written

        def batch_of(ids: list, contents: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([f"doc{k}.pdf" for k in ids]), pa.array(contents, pa.binary())], names=["doc_id", "name", "content"])

        for batch in batches:
            ids, contents, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = (text or "").split("\n")
                pages = [[(x.strip(), 72.0, 80.0 + PDF_PITCH * k) for k, x in enumerate(rows[n : n + PDF_LINES])] for n in range(0, len(rows), PDF_LINES)]
                ids.append(doc_id)
                contents.append(written(pages, packed=(doc_id or 0) % 2 == 0))
                size += len(contents[-1])
                if size > PDF_BATCH_BYTES:
                    yield batch_of(ids, contents)
                    ids, contents, size = [], [], 0
            if ids:
                yield batch_of(ids, contents)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, name string, content binary")


#: Pixels in a row of ``text_pictures``.
TEXT_WIDTH = 64


def text_pictures(docs: DataFrame) -> DataFrame:
    """``(doc_id, content, width, height)``: the bytes of each text as grey samples of a PNG whose rows take the five filters in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        from leafmill.sources.pixels import encode, handed_on

        def drawn(batch: pa.RecordBatch) -> Iterator[tuple]:
            # row by row: of a batch of many long texts, one at a time is held beside it
            for n in range(batch.num_rows):
                doc_id, text = batch.column(0)[n].as_py(), batch.column(1)[n].as_py()
                data = np.frombuffer((text or "").encode(), np.uint8)
                height = max(1, -(-len(data) // TEXT_WIDTH))
                grey = np.zeros(height * TEXT_WIDTH, dtype=np.uint8)
                grey[: len(data)] = data
                yield doc_id, encode(grey.reshape(height, TEXT_WIDTH, 1), kinds=(np.arange(height) + (doc_id or 0)) % 5), TEXT_WIDTH, height

        schema = pa.schema([("doc_id", pa.int64()), ("content", pa.binary()), ("width", pa.int32()), ("height", pa.int32())])
        for batch in batches:
            yield from handed_on(drawn(batch), schema, 1)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, content binary, width int, height int")


def samples_of(pictures: DataFrame) -> DataFrame:
    """What the column ``png`` shows as ``samples``, lower-case hex digits, in its place; rows are decoded one at a time and handed on by the megabyte."""
    kept = [f for f in pictures.schema.fields if f.name not in ("png", "samples")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from leafmill.sources.pixels import decode, handed_on

        def told(batch: pa.RecordBatch) -> Iterator[tuple]:
            for n in range(batch.num_rows):
                *own, png = (c[n].as_py() for c in batch.columns)
                yield *own, None if png is None else decode(png).tobytes().hex()

        for batch in batches:
            schema = pa.schema([*list(batch.schema)[:-1], pa.field("samples", pa.string())])
            yield from handed_on(told(batch), schema, len(schema) - 1)

    return pictures.select(*(f.name for f in kept), "png").mapInArrow(run, StructType([*kept, StructField("samples", StringType())]))
