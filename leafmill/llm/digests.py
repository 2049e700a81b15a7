"""What of the operators without SQL can be told in it: base counts, totals of documents and bytes, margins of shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmill.llm import quality, sharding, token_rollup
from leafmill.storage import fresh_path, stored


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base counts and rules of ``quality.judge``, under a model that keeps all."""
    keeps = quality.Model(np.zeros(1 << quality.BITS, np.float32), 1.0, 1.0, 0.0)
    return quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), keeps).drop("quality").withColumnRenamed("id", "doc_id")


QUALITY_BASE_SQL = rf"""
with d as (select doc_id, coalesce(text, '') t from documents), w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') w from d),
li as (select doc_id, unnest(string_split(t, chr(10))) l from d), dl as (select doc_id, count(*) - count(distinct l) n from li where regexp_matches(l, '[^\x20\x09-\x0D]') group by doc_id),
wi as (select doc_id, unnest(range(1, len(w) - 1)) i, w from w), sh as (select doc_id, i, w[cast(i as int)] || ' ' || w[cast(i + 1 as int)] || ' ' || w[cast(i + 2 as int)] s from wi),
tw as (select doc_id, i from sh qualify count(*) over (partition by doc_id, s) > 1), co as (select doc_id, count(*) n from (select distinct doc_id, unnest([i, i + 1, i + 2]) p from tw) group by doc_id),
c as (select doc_id, len(w) n_words, coalesce(cast(list_sum(list_transform(w, lambda x: length(x))) as bigint), 0) word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) n_symbols from w)
select c.*, coalesce(dl.n, 0) as n_dup_lines, coalesce(co.n, 0) as n_repeat_words, n_words < {quality.MIN_WORDS} or 100 * coalesce(co.n, 0) > {quality.MAX_REPEATED_PERCENT} * n_words as base_failed,
  not (n_words < {quality.MIN_WORDS} or 100 * coalesce(co.n, 0) > {quality.MAX_REPEATED_PERCENT} * n_words) as kept from c left join dl using (doc_id) left join co using (doc_id)"""


def rollup_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and bytes of a store after inserts, revised counts under another tokenizer, deletes of texts of under 100 bytes, and a batch sent twice."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    first = stored(token_rollup.count_tokens(docs, "byte-bpe-50k"), "token-counts")
    foreign, short = F.coalesce(F.col("lang") != "en", F.lit(True)), F.col("bytes") < 100
    second = stored(token_rollup.count_tokens(docs.filter(foreign), "byte-bpe-multi-50k"), "token-recounts")
    store = token_rollup.RollupStore(spark, fresh_path(spark, "token-rollup"))
    store.commit("insert", token_rollup.inserted(first))
    store.commit("revise", token_rollup.revised(first.filter(foreign), second))
    store.commit("delete", token_rollup.deleted(first.filter(~foreign & short)).unionByName(token_rollup.deleted(second.filter(short))))
    store.commit("insert", token_rollup.inserted(first))
    return store.totals().drop("tokens")


ROLLUP_DOCS_SQL = """
select source, lang, case when lang = 'en' then 'byte-bpe-50k' else 'byte-bpe-multi-50k' end as tokenizer_version, count(*) as docs, cast(sum(strlen(coalesce(text, ''))) as bigint) as bytes
from documents where strlen(coalesce(text, '')) >= 100 group by all"""


def shard_margins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each shard its rows and slots; of all shards the sums of sizes and checksums, which no exchange may change."""
    dealt = stored(sharding.shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("id", "size", "text_crc32", "shard", "slot"), "shard-places")
    sums = {"all_sizes": "size", "all_crc32": "text_crc32", "all_ids": "id"}
    each = dealt.groupBy("shard").agg(F.count("*").alias("n_rows"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.sum("slot").alias("slots"), *(F.sum(c).alias(k) for k, c in sums.items()))
    every = Window.partitionBy(F.lit(0))  # one row for each shard
    return each.withColumns({k: F.sum(k).over(every) for k in sums} | {"shard": F.col("shard").cast("long")})


_CRC = "xor(cast(list_reduce(range(0, 8 * strlen(t)), lambda c, j: xor(xor(c, case when j % 8 = 0 then ('0x' || substr(hx, cast(j // 4 + 1 as int), 2))::bigint else 0 end) >> 1, 3988292384 * (xor(c, case when j % 8 = 0 then ('0x' || substr(hx, cast(j // 4 + 1 as int), 2))::bigint else 0 end) & 1)), 4294967295) as bigint), 4294967295)"
SHARD_MARGINS_SQL = f"""
with d as (select doc_id, coalesce(text, '') t from documents), n as (select count(*) n, cast(sum(strlen(t) + 1) as bigint) all_sizes, cast(sum(doc_id) as bigint) all_ids from d),
u as (select t, hex(encode(t)) hx, count(*) k from d group by t), z as (select cast(sum(k * {_CRC}) as bigint) all_crc32 from u)
select shard, n // 8 + cast(shard < n % 8 as int) as n_rows, 0 as first_slot, n // 8 + cast(shard < n % 8 as int) - 1 as last_slot,
  cast((n // 8 + cast(shard < n % 8 as int)) * (n // 8 + cast(shard < n % 8 as int) - 1) // 2 as bigint) as slots, all_sizes, all_crc32, all_ids
from n cross join z cross join (select unnest(range(8)) shard) s where shard < n"""

QUERIES = {"quality_base": quality_base, "rollup_docs": rollup_docs, "shard_margins": shard_margins}
ORACLE_SQL = {"quality_base": QUALITY_BASE_SQL, "rollup_docs": ROLLUP_DOCS_SQL, "shard_margins": SHARD_MARGINS_SQL}
