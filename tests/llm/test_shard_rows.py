"""Shards hold whole rows."""

from __future__ import annotations

import collections

from leafmill.llm import sharding


def test_rows_are_whole(spark):
    rows = [(k % 7 or None, f"text {k % 5}", "en" if k % 2 else None, k) for k in range(60)] + [(1, None, "de", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n int")
    got = sharding.shard_rows(docs).collect()
    assert collections.Counter(tuple(r.row) for r in got) == collections.Counter(rows)
    assert all(r.id == r.row.doc_id and r.size == len((r.row.text or "").encode()) + 1 for r in got)
