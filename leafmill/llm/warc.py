"""WARC archives: deduplicated, segmented writing, and reassembly on reading.

Records are written with Spark's text writer (any file system, committed task by task). Each is a gzip member of its
own, so that it can be read at its offset; the writer's line separator is an empty gzip member. Blocks longer than a
segment go on in continuation records. Reading parses each file by its content lengths; whole records are decoded
where they are read, and only segments are shuffled, grouped by origin identifier and ordered by number; their
total length is verified, and the chunked transfer framing of the reassembled HTTP message is decoded.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import released, sliced
from leafmill.storage import fresh_path, stored

VERSION, TERMINATOR = b"WARC/1.1\r\n", b"\r\n\r\n"
SEGMENT_BYTES = 64 << 10
CHUNK_BYTES = 8 << 10
#: An empty gzip member, one character a byte.
EMPTY_MEMBER = gzip.compress(b"", mtime=0).decode("latin-1")
#: Bytes of decoded blocks that a reader holds at once, besides the file.
BATCH_BYTES = 4 << 20
#: Records a file holds at most: with the segment size, a bound on what a reader loads at once.
FILE_RECORDS = 1000
DATE = "1970-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(body: bytes, size: int = CHUNK_BYTES) -> bytes:
    """Chunked transfer framing."""
    parts = []
    for k in range(0, len(body), size):
        part = body[k : k + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(framed: bytes) -> bytes | None:
    """The body of chunked framing (extensions and trailers passed over); None if it is broken."""
    parts, at = [], 0
    while True:
        end = framed.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(framed[at:end].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts) if framed.find(b"\r\n", at) >= 0 else None
        if size < 0 or framed[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(framed[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The payload of an HTTP response message."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        return None
    lines = [x.partition(b":") for x in head.split(b"\r\n")[1:]]
    coded = any(n.strip().lower() == b"transfer-encoding" and b"chunked" in v.lower() for n, _, v in lines)
    return unchunked(body) if coded else body


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    text = "".join(f"{n}: {v}\r\n" for n, v in fields if v is not None)
    return VERSION + f"{text}Content-Length: {length}\r\n\r\n".encode()


def _records(ident: str, url: str | None, refers: str | None, payload: bytes, segment: int) -> Iterator[bytes]:
    """A response in segments, or a revisit; without the terminator."""
    clean = "".join(c for c in url if c not in "\r\n") if url else None
    digest = f"sha1:{digest_of(payload)}"
    own = [("WARC-Record-ID", f"<{ident}>"), ("WARC-Date", DATE), ("WARC-Target-URI", clean), ("WARC-Payload-Digest", digest)]
    if refers:
        profile = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
        yield _head([("WARC-Type", "revisit"), *own, ("WARC-Profile", profile), ("WARC-Refers-To", f"<{refers}>")], 0)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    kind = ("Content-Type", "application/http;msgtype=response")
    if len(block) <= segment:
        yield _head([("WARC-Type", "response"), *own, kind], len(block)) + block
        return
    count = -(-len(block) // segment)
    for k in range(count):
        part = block[k * segment : (k + 1) * segment]
        total = len(block) if k == count - 1 else None
        if k == 0:
            fields = [("WARC-Type", "response"), *own, kind, ("WARC-Segment-Number", 1)]
        else:
            fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{ident}:{k + 1}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", f"<{ident}>"), ("WARC-Segment-Number", k + 1), ("WARC-Segment-Total-Length", total)]
        yield _head(fields, len(part)) + part


def write_archive(records: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write ``(record_id string, url string, refers_to string, payload binary)`` as WARC files of gzip members below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 3):
            out: list[bytes] = []
            for ident, url, refers, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out.extend(gzip.compress(r + TERMINATOR, 6, mtime=0) for r in _records(ident, url, refers, payload or b"", segment_bytes))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    lines = records.select("record_id", "url", "refers_to", "payload").mapInArrow(lambda batches: released(run(batches)), "value binary")
    writer = lines.select(F.col("value").cast("string").alias("value")).write
    writer.option("lineSep", EMPTY_MEMBER).option("encoding", "ISO-8859-1").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflated(raw: bytes) -> Iterator[bytes]:
    """A file in parts: one for each gzip member, or the whole of one that is not compressed."""
    if raw[:2] != b"\x1f\x8b":
        yield raw
        return
    while raw:
        member = zlib.decompressobj(31)
        yield member.decompress(raw) + member.flush()
        if not member.eof:
            raise ValueError("the archive ends within a gzip member")
        raw = memoryview(member.unused_data) if member.unused_data else b""


def parse(parts: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record; a record may be a part of its own or lie within one."""
    data, at = b"", 0
    for part in parts:
        data, at = data[at:] + part, 0
        while at < len(data):
            end = data.find(b"\r\n\r\n", at)
            if end < 0:
                break
            if not data.startswith(b"WARC/", at):
                raise ValueError("no record where one should begin")
            lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
            fields = {n.lower(): v.strip() for n, _, v in (x.partition(":") for x in lines)}
            size = int(fields["content-length"])
            if end + 4 + size > len(data):
                break
            yield fields, data[end + 4 : end + 4 + size]
            at = min(len(data), end + 4 + size + len(TERMINATOR))
    if data[at:].strip():
        raise ValueError("the archive ends within a record")


PARSED = "origin string, number int, kind string, refers_to string, digest string, total long, payload_bytes long, found string, block binary"
_NAMES = [c.split()[0] for c in PARSED.split(", ")]
_TYPES = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]


def _parsed(f: dict[str, str], block: bytes, keep_payload: bool) -> tuple:
    ident, kind, number = f["warc-record-id"].strip("<>"), f["warc-type"], f.get("warc-segment-number")
    total = f.get("warc-segment-total-length")
    refers = f["warc-refers-to"].strip("<>") if "warc-refers-to" in f else None
    origin = f["warc-segment-origin-id"].strip("<>") if kind == "continuation" else ident
    digest = f.get("warc-payload-digest", "").removeprefix("sha1:") or None
    size = found = kept = None
    if number is not None:
        kept = block
    elif kind == "response":
        payload = payload_of(block)
        size, found = (None, None) if payload is None else (len(payload), digest_of(payload))
        kept = payload if keep_payload else None
    return origin, number and int(number), None if kind == "continuation" else kind, refers, digest, total and int(total), size, found, kept


def read_segments(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """A row for each record: whole ones decoded, segments with their blocks.

    A file is one value of Spark's binary reader, which ``write_archive`` bounds by FILE_RECORDS segments; archives of
    other makers should be cut at record bounds if they are larger than a task's memory allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, held = [], 0
                for fields, block in parse(inflated(batch.column(0)[k].as_py())):
                    rows.append(_parsed(fields, block, keep_payload))
                    held += len(rows[-1][-1] or b"") + 200
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("content").mapInArrow(lambda batches: released(run(batches)), PARSED)


def read_archive(spark: SparkSession, path: str, keep_payload: bool = False) -> DataFrame:
    """``(record_id, kind, refers_to, digest, payload_bytes, payload_digest, status[, payload])`` of every record.

    The segments of one origin identifier are one record; if it was written several times, whole, it comes back as often.
    digest is what the header claims, payload_digest what the decoded payload has. status: ``ok``; ``bad length`` if
    segments are missing or their total is not as told; ``bad framing``; ``bad digest``. A revisit has no payload of its own.
    """
    rows = read_segments(spark, path, keep_payload)
    alone = F.col("number").isNull()
    bad = F.when(F.col("payload_bytes").isNull(), "bad framing").when(F.col("digest") != F.col("found"), "bad digest").otherwise("ok")
    status = F.when(F.col("kind") == "response", bad).otherwise("ok")
    columns = ("record_id", "kind", "refers_to", "digest", "payload_bytes", "payload_digest", "status", "payload")
    whole = rows.filter(alone).select(F.col("origin").alias("record_id"), "kind", "refers_to", "digest", "payload_bytes", F.col("found").alias("payload_digest"), status.alias("status"), F.col("block").alias("payload"))
    grouped = rows.filter(~alone).groupBy("origin").agg(
        *(F.max(c).alias(c) for c in ("kind", "refers_to", "digest", "total")), F.count_if(F.col("number") == 1).alias("copies"), F.sort_array(F.collect_set(F.struct("number", "block"))).alias("parts")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                size = found = payload = None
                block = b"".join(p["block"] for p in r["parts"])
                if [p["number"] for p in r["parts"]] != list(range(1, len(r["parts"]) + 1)) or len(block) != r["total"] or r["kind"] is None:
                    state = "bad length"
                else:
                    payload = payload_of(block)
                    if payload is not None:
                        size, found = len(payload), digest_of(payload)
                    state = "bad framing" if size is None else "bad digest" if r["digest"] and r["digest"] != found else "ok"
                rows.append((r["origin"], r["kind"], r["refers_to"], r["digest"], size, found, state, max(1, r["copies"]), payload if keep_payload else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "record_id string, kind string, refers_to string, digest string, payload_bytes long, payload_digest string, status string, copies long, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    joined = grouped.mapInArrow(lambda batches: released(run(batches)), schema)
    joined = joined.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    out = whole.unionByName(joined.select(*columns))
    return out if keep_payload else out.drop("payload")


#: Parts that a payload's response, or its length, is copied into before a join, so that no repeated payload is hot.
SALTS = 16


def archive_pages(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment_bytes: int = SEGMENT_BYTES) -> None:
    """Write a record for every row; of equal payloads that of the largest id is a response, others revisit it.

    Null html is an empty payload. Rows that repeat an id and payload are records of the same name and kind, so all
    rows of the largest id are responses; a null id revisits like any other row, and is never the largest unless all
    are null. An empty table writes an empty archive; other columns are not kept.
    """
    payload = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    base = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), payload.alias("payload")).withColumn("same", F.sha2("payload", 256))
    groups = base.groupBy("same").agg(F.max("id").alias("keeper"), F.count("*").alias("n")).filter("n > 1").select("same", "keeper")
    groups = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = base.withColumn("salt", F.pmod(F.xxhash64("id", "url"), F.lit(SALTS)).cast("int")).join(groups, ["same", "salt"], "left")

    def name(c: str):
        return F.concat(F.lit("urn:leafmill:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(":"), F.substring("same", 1, 40))

    refers = F.when(F.col("keeper").isNotNull() & ~F.expr("id <=> keeper"), name("keeper"))
    write_archive(rows.select(name("id").alias("record_id"), "url", refers.alias("refers_to"), "payload"), path, segment_bytes)


def page_records(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to, status)`` of every record of ``archive_pages``;
    a revisit has the length of what it refers to."""
    records = stored(read_archive(spark, path), "warc-records")
    own = F.split("record_id", ":")[2]
    page = F.when(own != "none", own).cast("long")
    referred = records.filter("kind = 'revisit'").select(F.col("refers_to").alias("to")).distinct()
    lengths = records.filter("kind = 'response'").groupBy(F.col("record_id").alias("to")).agg(F.max("payload_bytes").alias("n")).join(referred, "to")
    lengths = lengths.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = records.withColumn("salt", F.when(F.col("kind") == "revisit", F.pmod(F.xxhash64("record_id"), F.lit(SALTS)).cast("int")))
    joined = salted.join(lengths, (salted["refers_to"] == lengths["to"]) & (salted["salt"] == lengths["salt"]), "left")
    refers = F.split("refers_to", ":")[2]
    return joined.select(
        page.alias("page_id"), F.coalesce("payload_bytes", "n").alias("payload_bytes"), F.coalesce("payload_digest", "digest").alias("payload_digest"),
        F.col("kind").alias("record_type"), F.when(refers != "none", refers).cast("long").alias("refers_to"), "status",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return page_records(spark, path)


#: base32 of the SHA-1: five bits a digit of the digest's bits
SQL = """
with p as (select page_id, coalesce(html, '') body from pages),
d as (select page_id, strlen(body) payload_bytes, sha1(body) hex, max(page_id) over (partition by body) keeper from p),
bits as (select *, list_reduce(list_transform(string_split(hex, ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), lambda a, b: a || b) b from d)
select page_id, payload_bytes,
  list_reduce(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(1 + list_sum(list_transform(range(0, 5), lambda j: cast(b[cast(k * 5 + j + 1 as int)] as int) << cast(4 - j as int))))::int]), lambda a, b: a || b) as payload_digest,
  case when page_id = keeper then 'response' else 'revisit' end as record_type, case when page_id <> keeper then keeper end as refers_to, 'ok' as status
from bits"""
