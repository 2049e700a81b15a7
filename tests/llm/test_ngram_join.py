"""The n-gram join against all pairs of sets, on small lists, spread lists and several blocks."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

from leafmill.llm import ngram_join
from leafmill.llm.shingle_sets import shingle_sets


def text_set(text: str | None, words: int) -> frozenset:
    own = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(own[k : k + words]) for k in range(max(1, len(own) - words + 1))) if own else frozenset()


def brute(rows: list[tuple], words: int, percent: int) -> dict:
    sets = [text_set(t, words) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for x in range(len(rows)):
        for y in range(x):
            if sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                links[x] += 1
                links[y] += 1
                root[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(i, least.get(find(x), i))
    return sorted(((i, len(sets[x]), least.get(find(x)) if sets[x] else i, links[x]) for x, (i, _) in enumerate(rows)), key=str)


def corpus() -> list[tuple]:
    rng = random.Random(11)
    rows, at = [], 0
    for family in range(12):
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice((4, 12, 40, 90)))]
        for _ in range(rng.choice((2, 6, 14))):
            own = list(base)
            for _ in range(rng.randrange(4)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(9)}"
            if rng.random() < 0.4:
                own += ["tail", "tail"] * rng.randrange(1, 3)
            rows.append((at, " ".join(own).title() if at % 5 == 0 else "\t".join(own)))
            at += 1
    copy = rows[3][1]
    return rows + [(None, copy), (900, copy), (901, None), (902, ""), (903, " \n"), (904, "one"), (905, "One"), (906, "one two"), (900, copy), (907, "long " + "word " * 60_000)]


@pytest.mark.parametrize(
    ("words", "percent", "limits"),
    [(3, 90, {}), (2, 60, {"small": 3, "heavy": 0}), (3, 80, {"small": 2, "block_sets": 3, "broadcast_rows": 0}), (1, 70, {"small": 4, "block_shingles": 50})],
)
def test_all_links_by_brute_force(spark, words, percent, limits):
    rows = corpus()
    docs = spark.createDataFrame([(a, b, "x", "y") for a, b in rows], "doc_id long, text string, digest string, component string").repartition(5)
    got = [tuple(r) for r in ngram_join.similar(docs, shingle_words=words, percent=percent, **limits).collect()]
    assert sorted(got, key=str) == brute(rows, words, percent)


def test_empty_table(spark):
    assert ngram_join.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert sorted(tuple(r) for r in ngram_join.similar(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()) == [(1, 0, 1, 0), (2, 0, 2, 0)]


def test_sets_of_batches_equal_those_of_single_texts():
    texts = [t.encode() for _, t in corpus() if t]
    raw, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    flat, ends = shingle_sets(raw, at, 3)
    for k, text in enumerate(texts):
        alone, _ = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 3)
        assert (flat[ends[k] : ends[k + 1]] == alone).all() and len(alone) == len(text_set(text.decode(), 3))


def test_depth_follows_costs():
    cheap, dear = np.ones(30), np.concatenate([np.ones(20), np.full(10, 1e6)])
    assert ngram_join.depths(cheap, 10, 4) == 4
    assert ngram_join.depths(dear, 20, 4) == 1


@pytest.mark.parametrize(("words", "percent", "limits"), [(3, 90, {"small": 2, "wide": 3}), (1, 70, {"small": 1}), (2, 50, {"small": 2}), (3, 80, {"small": 1, "wide": 0})])
def test_all_links_through_large_lists(spark, words, percent, limits):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [tuple(r) for r in ngram_join.similar(docs, shingle_words=words, percent=percent, **limits).collect()]
    assert sorted(got, key=str) == brute(rows, words, percent)


def frequent(words: int, vocabulary: int) -> list[tuple]:
    """Texts of few different words: each of their shingles is in many of them, but no two are alike, save the last two."""
    rng = random.Random(5)
    rows = [(k, " ".join(rng.choice("abcdefgh"[:vocabulary]) for _ in range(words))) for k in range(400)]
    return rows + [(400, rows[0][1] + " new"), (401, rows[0][1] + " other")]


def grouped(monkeypatch) -> list[int]:
    """Gets how many sets come together to be verified."""
    sizes, planned = [], ngram_join._planned
    monkeypatch.setattr(ngram_join, "_planned", lambda groups, *more: sizes.append(groups.count()) or planned(groups, *more))
    return sizes


def test_frequent_shingles_make_no_groups(spark, monkeypatch):
    rows, sizes = frequent(40, 5), grouped(monkeypatch)
    got = [tuple(r) for r in ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()]
    assert sorted(got, key=str) == brute(rows, 3, 90)
    assert sizes == [3]


def test_parity_bits_allow_every_link():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90, 99):
        for n in (3, 20, 150, 700, 5000, 90_000 if percent == 90 else 1000):
            base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            sets = [base]
            for _ in range(12):
                gone, new = rng.integers(0, 1 + n * (100 - percent) // 90, 2)
                sets.append(np.concatenate([base[gone:], rng.integers(0, 1 << 63, new, dtype=np.uint64)]))
            sets = sorted((x for x in sets if len(x)), key=len)
            at = np.cumsum([0, *map(len, sets)])
            bits = ngram_join.parity_bits(np.concatenate(sets), at, percent)
            a, b = ngram_join.alike(np.diff(at), np.frombuffer(b"".join(bits), np.uint8), np.cumsum([0, *map(len, bits)]), percent)
            root = list(range(len(sets)))
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                old, new = root[y], root[x]
                root = [new if r == old else r for r in root]
            for x in range(len(sets)):
                for y in range(x):
                    shared = len(np.intersect1d(sets[x], sets[y]))
                    union = len(sets[x]) + len(sets[y]) - shared
                    assert root[x] == root[y] or 100 * shared < percent * union or shared == union
