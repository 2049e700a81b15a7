"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Rows are dealt to source buckets by a hash of their content. How many rows of each bucket go to each
shard is drawn on the driver from the exact multivariate hypergeometric law, given both margins (a table
of buckets x shards, whatever the rows). Each bucket then permutes its rows and cuts them by those
counts, and every shard permutes what it gets, in slices that are numbered by prefix sums. All orders come
from seeded hashes of the rows, so a lost task repeats itself. Whole rows move: once to their bucket, once to their
place in a shard.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.storage import fresh_path

SHARDS = 8
SEED = 20240
#: Rows that a source bucket or a slice of a shard holds on average, at most.
BUCKET_ROWS = 100_000


def _hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """One exact draw; NumPy's own is limited to populations below 10**9."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    total = good + bad
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    spread = int(12 * math.sqrt(draws * (good / total) * (bad / total) * (total - draws) / max(1, total - 1))) + 10
    x = np.arange(max(low, mode - spread), min(high, mode + spread) + 1)
    k = x[:-1].astype(float)
    steps = np.log(good - k) + np.log(draws - k) - np.log(k + 1) - np.log(bad - draws + k + 1)
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    p = np.exp(logs - logs.max())
    return int(x[np.searchsorted(np.cumsum(p), rng.random() * p.sum())])


def communication_matrix(rows: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Counts by bucket and shard with these margins, drawn as a uniform permutation would give them."""
    if sum(rows) != sum(shards):
        raise ValueError("margins differ")
    rng = np.random.default_rng(seed)
    left = list(shards)
    out = np.zeros((len(rows), len(shards)), np.int64)
    for i, n in enumerate(rows):
        rest = sum(left)
        for j in range(len(left)):
            take = n if j == len(left) - 1 else _hypergeometric(rng, left[j], rest - left[j], n)
            rest -= left[j]
            out[i, j] = take
            n -= take
            left[j] -= take
    return out


def shard_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``(id, size, text_crc32, row, shard, slot)``, written by shard: row holds all columns of docs; shard sizes
    differ by one at most, and slots run gapless from zero in each shard.

    size: UTF-8 bytes of the text plus one (null: one); text_crc32: unsigned, of an empty text if null.
    Repeated rows are rows of their own; null ids are dealt like any other; empty tables give an empty
    result. With repeated rows the order depends on the input's partitions too.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"),
    )
    n = docs.count()
    buckets = max(1, min(100_000, -(-n // BUCKET_ROWS) * 8))

    def hashed(salt: int) -> Column:
        return F.xxhash64(F.lit(seed + salt), "id", "size", "text_crc32", "part", "copy")

    # equal rows would all fall into one bucket: number the copies first, so that each is dealt alone. They are numbered
    # within their input partition, which is part of the key, so no task ever has more of them than one input split holds
    every = F.xxhash64(*(F.col(f"row.`{c}`") for c in docs.columns if "map<" not in docs.schema[c].dataType.simpleString()))
    same = Window.partitionBy("id", "size", "text_crc32", "part").orderBy("text_hash", every)
    if _has_copies(rows):
        rows = rows.withColumn("part", F.spark_partition_id()).withColumn("copy", F.row_number().over(same))
    else:
        rows = rows.withColumns({"part": F.lit(0), "copy": F.lit(1)})
    rows = rows.drop("text_hash").withColumn("bucket", F.pmod(hashed(0), F.lit(buckets)).cast("int"))
    counts = {b: c for b, c in rows.groupBy("bucket").count().collect()}  # at most 100 000 numbers
    present = sorted(counts)
    total = sum(counts.values())
    sizes = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = communication_matrix([counts[b] for b in present], sizes, seed)
    ends = np.cumsum(matrix, axis=1)
    cuts = spark.createDataFrame([(int(b), [int(e) for e in ends[k]]) for k, b in enumerate(present)], "bucket int, ends array<long>")
    order = Window.partitionBy("bucket").orderBy(hashed(1), "id", "size", "text_crc32", "part", "copy")
    ranked = rows.withColumn("rank", F.row_number().over(order)).join(F.broadcast(cuts), "bucket")
    shard = F.size(F.filter("ends", lambda e: e < F.col("rank")))
    slices = max(1, min(100_000 // shards, -(-total // shards // BUCKET_ROWS) * 2))
    dealt = ranked.select("row", "id", "size", "text_crc32", "part", "copy", shard.cast("int").alias("shard"), F.pmod(hashed(2), F.lit(slices)).cast("int").alias("slice"))
    held = {(s, k): c for s, k, c in dealt.groupBy("shard", "slice").count().collect()}
    starts, at = [], 0
    for s in range(shards):
        at = 0
        for k in range(slices):
            starts.append((s, k, at))
            at += held.get((s, k), 0)
    starts = spark.createDataFrame(starts, "shard int, slice int, start long")
    within = Window.partitionBy("shard", "slice").orderBy(hashed(3), "id", "size", "text_crc32", "part", "copy")
    placed = dealt.withColumn("nth", F.row_number().over(within)).join(F.broadcast(starts), ["shard", "slice"])
    out = placed.select("id", "size", "text_crc32", "row", "shard", (F.col("start") + F.col("nth") - 1).alias("slot"))
    path = fresh_path(spark, "shards")
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def _has_copies(rows: DataFrame) -> bool:
    return not rows.groupBy("id", "size", "text_crc32").count().filter("count > 1").limit(1).isEmpty()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return dealt.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
