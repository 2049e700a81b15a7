"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from leafmill.llm import centroids, decontaminate, digests, ngram_join, pieces, quality, sharding, simhash, suffix_dedup, token_rollup, toxicity, turns, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.query,
    "op2_token_rollup": token_rollup.query,
    "op3_url_filter": url_filter.query,
    "op4_decontaminate": decontaminate.query,
    "op5_quality": quality.query,
    "op6_sharding": sharding.query,
    "op7_toxicity": toxicity.query,
    "op8_simhash": simhash.query,
    "op9_pieces": pieces.query,
    "op10_suffix_dedup": suffix_dedup.query,
    "op11_ngram_join": ngram_join.query,
    "op12_centroids": centroids.query,
    "op13_turns": turns.query,
    **digests.QUERIES,
}

ORACLE_SQL: dict[str, str] = {"op1_warc": warc.SQL, "op3_url_filter": url_filter.SQL, "op4_decontaminate": decontaminate.SQL, "op8_simhash": simhash.SQL, "op10_suffix_dedup": suffix_dedup.SQL, "op11_ngram_join": ngram_join.SQL, "op12_centroids": centroids.SQL, "op13_turns": turns.SQL, **digests.ORACLE_SQL}
