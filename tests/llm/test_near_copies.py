"""Near copies of the pipeline: every link by brute force, whatever the fingerprint says."""

from __future__ import annotations

import random

from leafmill.llm import near_copies, ngram_join
from test_ngram_join import brute, frequent, grouped


def corpus() -> list[tuple]:
    rng = random.Random(4)
    rows, at = [], 0
    for pair in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        # one changed word changes five of 200 shingles: 4 leave 0.818, 5 leave 0.778
        changed = list(words)
        for k in range(4 + pair % 2):
            changed[20 + 30 * k] = "changed"
        rows += [(at, " ".join(words)), (at + 1, " ".join(changed))]
        at += 2
    base = [f"b{k}" for k in range(150)]
    for _ in range(40):  # one large group, from near to far
        own = list(base)
        for _ in range(rng.randrange(1, 9)):
            own[rng.randrange(len(own))] = f"y{rng.randrange(50)}"
        rows.append((at, " ".join(own)))
        at += 1
    return rows + [(None, rows[0][1]), (902, rows[0][1]), (903, "one two"), (904, "ONE two")]


def test_all_links_by_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, digest string").repartition(3)
    got = sorted(((r.id, r.component_id) for r in near_copies.near_copies(frame).collect()), key=str)
    assert got == sorted(((i, c) for i, _, c, _ in brute(rows, 5, 80)), key=str)


def test_texts_without_words_are_copies(spark):
    rows = [(5, None, "a"), (4, "", "b"), (6, " \n", "c"), (7, "word", "d"), (None, "word", "e"), (7, "word", "d")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n string")
    out = near_copies.without_near_copies(frame)
    assert out.columns == ["doc_id", "text", "n"] and sorted(tuple(r) for r in out.collect()) == [(4, "", "b"), (7, "word", "d")]


def test_rows_that_go_are_no_shuffle_of_whole_rows(spark, monkeypatch):
    """Beyond the rows that are sent around, the numbers of those that go reach the scan as bits."""
    rows = [(k, " ".join(f"w{k % 30}x{i}" for i in range(20))) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(ngram_join, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ngram_join.groups_of, "__defaults__", (*ngram_join.groups_of.__defaults__[:-1], 0))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = near_copies.without_near_copies(docs)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in out.collect()) == list(range(30))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan


def test_marked_rows(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 32769, 65536, (1 << 33) - 1, 1 << 33, (1 << 33) + 1, 5 << 33]
    rows = spark.createDataFrame([(n,) for n in sorted({x + d for x in numbers for d in (-1, 0, 1) if x + d >= 0})], "nth long")
    out = ngram_join.marked(rows, spark.createDataFrame([(n,) for n in numbers], "nth long")).filter("marked").collect()
    assert sorted(r.nth for r in out) == numbers
    assert ngram_join.marked(rows, rows.filter("false")).filter("marked").isEmpty()


def test_frequent_shingles_make_no_groups(spark, monkeypatch):
    rows, sizes = frequent(60, 3), grouped(monkeypatch)
    got = sorted(((r.id, r.component_id) for r in near_copies.near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted(((i, c) for i, _, c, _ in brute(rows, 5, 80)), key=str)
    assert sizes[0] < 20
