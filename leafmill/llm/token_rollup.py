"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A store is a folder: ``deltas/<name>`` holds a batch's signed sums (Parquet). A batch is committed when its entry,
``log/batch-<hash of its id>.json``, appears: it is written beside and renamed, so it is never seen in part.
There is one entry for a batch id, whoever wrote it last, and it names one folder: so sums written before a
crash, or twice by two writers, count once. ``log/base-<n>.json`` stands for all batches that a compaction has summed up.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmill.llm.arrowtext import released, sliced
from leafmill.storage import fresh_path

KEYS = ("source", "lang", "tokenizer_version")
SUMS = ("docs", "tokens", "bytes")
TOKENIZERS = {"byte-bpe-50k": "/opt/tokenizers/byte_bpe_50k.tiktoken", "byte-bpe-multi-50k": "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"}


def count_tokens(docs: DataFrame, version: str, path: str | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, with ``tokenizer_version``, ``tokens`` and ``bytes`` of the whole text (null and empty: 0).

    Columns of docs that have one of these three names are replaced, all others stay; every row gives a row, repeated or
    without an id; an empty table gives an empty result.
    """
    where = path or TOKENIZERS[version]
    keep = [c for c in docs.columns if c not in (text_col, "tokenizer_version", "tokens", "bytes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import tiktoken

        with open(where, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        encode = tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in sliced(batches, len(keep)):
            texts = batch.column(batch.num_columns - 1).to_pylist()
            tokens = pa.array([len(encode(t)) if t else 0 for t in texts], pa.int64())
            size = pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([version] * batch.num_rows), tokens, size], names=[*batch.schema.names[:-1], "tokenizer_version", "tokens", "bytes"])

    rows = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias("own text"))
    schema = docs.select(*(F.col(f"`{c}`") for c in keep)).schema.add("tokenizer_version", "string").add("tokens", "long").add("bytes", "long")
    return rows.mapInArrow(lambda batches: released(run(batches)), schema)


def inserted(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(1).cast("long").alias("docs"), "tokens", "bytes")


def deleted(rows: DataFrame) -> DataFrame:
    return rows.select(*KEYS, F.lit(-1).cast("long").alias("docs"), (-F.col("tokens")).alias("tokens"), (-F.col("bytes")).alias("bytes"))


def revised(before: DataFrame, after: DataFrame) -> DataFrame:
    """A revised count takes its old row back and puts its new one."""
    return deleted(before).unionByName(inserted(after))


class RollupStore:
    """Additive totals in a shared folder, on any file system that Spark reads and that renames a file whole.

    Any number of writers may commit at a time, also the same batch (both may then be told that it was
    applied; it counts once). One at a time may compact, while others commit.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/log/{name}"))
        entry = json.loads(bytes(stream.readAllBytes()).decode())
        stream.close()
        return entry

    def _names(self) -> list[str]:
        folder = self._at(f"{self.path}/log")
        return sorted(str(s.getPath().getName()) for s in self._fs.listStatus(folder)) if self._fs.exists(folder) else []

    def _log(self) -> tuple[set[str], list[str], int]:
        """Hashes of the batches applied, delta folders in force, and the number of the next base."""
        names = self._names()
        bases = [n for n in names if n.startswith("base-") and n.endswith(".json")]
        base = self._read(bases[-1]) if bases else {"batches": [], "folders": []}
        batches, live = set(base["batches"]), list(base["folders"])
        for name in names:
            own = name.removeprefix("batch-").removesuffix(".json")
            if name == f"batch-{own}.json" and own not in batches:
                live.append(self._read(name)["folder"])
                batches.add(own)
        return batches, live, int(bases[-1][5:-5]) + 1 if bases else 0

    def _put(self, name: str, entry: dict) -> None:
        """Write beside, then rename: a reader finds the entry whole or not at all."""
        beside = self._at(f"{self.path}/tmp/{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(entry).encode()))
        stream.close()
        self._fs.mkdirs(self._at(f"{self.path}/log"))
        if not self._fs.rename(beside, self._at(f"{self.path}/log/{name}")):
            self._fs.delete(beside, False)
            if name not in self._names():
                raise OSError(f"cannot put {name} into the log")

    def commit(self, batch_id: str, changes: DataFrame) -> bool:
        """Apply signed changes once; False if this batch was applied before (nothing is computed then).

        Null sources and languages are keys of their own; no changes make a batch without sums, which counts as applied.
        """
        own = hashlib.sha256(batch_id.encode()).hexdigest()
        if own in self._log()[0]:
            return False
        sums = changes.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS))
        folder = fresh_path(self.spark, "delta").rsplit("/", 1)[1]
        sums.write.parquet(f"{self.path}/deltas/{folder}")
        if own in self._log()[0]:
            return False
        self._put(f"batch-{own}.json", {"batch": batch_id, "folder": folder})
        return True

    def _sums(self, live: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer_version string, docs long, tokens long, bytes long"
        if not live:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*(f"{self.path}/deltas/{d}" for d in live))
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).filter("docs <> 0 or tokens <> 0 or bytes <> 0")

    def totals(self) -> DataFrame:
        """Keys whose totals are not all zero."""
        return self._sums(self._log()[1])

    def compact(self) -> None:
        """Replace what is in force by its sum; applied batches stay known.

        Log entries that the base before had summed up already are removed, so the log holds the batches since then.
        """
        batches, live, number = self._log()
        names = self._names()
        folder = fresh_path(self.spark, "base").rsplit("/", 1)[1]
        self._sums(live).write.parquet(f"{self.path}/deltas/{folder}")
        bases = [n for n in names if n.startswith("base-")]
        known = set(self._read(bases[-1])["batches"]) if bases else set()
        self._put(f"base-{number:08d}.json", {"batches": sorted(batches), "folders": [folder]})
        for name in [n for n in names if n.removeprefix("batch-").removesuffix(".json") in known] + bases[:-1]:
            self._fs.delete(self._at(f"{self.path}/log/{name}"), False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents, recount those not in English under a second tokenizer, delete those of under
    20 tokens, send two batches again, and compact. Null sources and languages are groups of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    from leafmill.storage import stored

    first = stored(count_tokens(docs, "byte-bpe-50k"), "token-counts")
    foreign = F.coalesce(F.col("lang") != "en", F.lit(True))
    second = stored(count_tokens(docs.filter(foreign), "byte-bpe-multi-50k"), "token-recounts")
    short = F.col("tokens") < 20
    store = RollupStore(spark, fresh_path(spark, "token-rollup"))
    store.commit("insert-1", inserted(first))
    store.commit("revise-1", revised(first.filter(foreign), second))
    store.commit("insert-1", inserted(first))
    store.commit("delete-1", deleted(first.filter(~foreign & short)).unionByName(deleted(second.filter(short))))
    store.commit("revise-1", revised(first.filter(foreign), second))
    store.compact()
    return store.totals()
