"""Each operator against brute force, on rows with nulls, empty and long texts, ties, copies and clashing columns."""

from __future__ import annotations

import base64
import collections
import glob
import gzip
import hashlib
import json
import os
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from leafmill.llm import decontaminate, pieces, quality, sharding, simhash, suffix_dedup, token_rollup, toxicity, url_filter, warc
from leafmill.storage import fresh_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, doc long, fp string, key string, kh long, marks string, z string"


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 5, 40, 120]))) for _ in range(40)]
    passage = " ".join(rng.choice(words) for _ in range(70))
    texts += [passage + " x " + texts[5], texts[6] + "\n" + passage, passage, passage, "", "   ", None, "a " * 500, "line\n\n line\nline\nline", "汉字 😀 " * 80]
    texts += [t + " end" for t in texts[:5] if t] + [texts[9], texts[9], " ".join(rng.choice(words) for _ in range(6000))]
    rows = [(k, t) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[41], (5, "another text of an id that is there already " * 5), (None, texts[8]), (None, None)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None, 7, 8, "x", "k", 1, "m", "z") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- SimHash


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = words_of(low)
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    ones = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if ones[b] * 2 > len(shingles))


def test_simhash_groups(docs):
    rows = corpus()
    prints = [brute_fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((rows[k][0] for k in range(len(rows)) if group[k] == g and rows[k][0] is not None), default=None) for g in set(group)}
    want = collections.Counter((rows[k][0], f"{prints[k]:016x}", least[group[k]]) for k in range(len(rows)))
    got = collections.Counter((r.id, bytes(r.fp).hex(), r.component_id) for r in simhash.simhash_groups(docs).collect())
    assert got == want


def test_golay_keys_meet_within_three_bits():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    y = x.copy()
    for k in range(500):
        for b in rng.choice(64, rng.integers(0, 4), replace=False):
            y[k] ^= np.uint64(1 << int(b))
    keys = []
    for v in (x, y):
        rows, own = simhash.golay_keys(v[:, None])
        assert np.bincount(rows).max() <= 33
        keys.append([set(own[rows == k].tolist()) for k in range(500)])
    assert all(a & b for a, b in zip(*keys, strict=True))


def test_large_buckets_are_split(spark):
    rng = np.random.default_rng(7)
    base = int(rng.integers(0, 1 << 62))
    values = {base}
    while len(values) < 400:
        x = list(values)[int(rng.integers(len(values)))]
        for b in rng.choice(64, int(rng.integers(1, 9)), replace=False):
            x ^= 1 << int(b)
        values.add(x)
    prints = spark.createDataFrame([(bytearray(v.to_bytes(8, "big")),) for v in values], "fp binary")

    def components(links):
        group = {v: v for v in values}
        for a, b in links:
            old, new = group[a], group[b]
            group = {k: new if g == old else g for k, g in group.items()}
        return collections.Counter(frozenset(k for k, g in group.items() if g == x) for x in set(group.values()))

    want = components([(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 3])
    for oversize in (2, 30, 10_000):
        links = [(int.from_bytes(r.src, "big"), int.from_bytes(r.dst, "big")) for r in simhash.golay_links(prints, oversize=oversize).collect()]
        assert all((a ^ b).bit_count() <= 3 for a, b in links) and components(links) == want


def test_dense_bucket_gives_a_forest():
    base = np.uint64(0x123456789ABCDEF0)
    prints = np.array([[base ^ np.uint64(1 << a) ^ np.uint64(1 << b)] for a in range(40) for b in range(a)])
    a, b = simhash.links_of(np.zeros(len(prints), np.int64), prints, 3)
    assert len(a) < len(prints)
    reached = {0}
    for _ in range(len(prints)):
        reached |= {int(y) for x, y in zip(a, b, strict=True) if int(x) in reached} | {int(x) for x, y in zip(a, b, strict=True) if int(y) in reached}
    assert reached == set(range(len(prints)))


# ---- repeated windows


def brute_repeats(rows, threshold):
    ordered = sorted({(i is None, i or 0, hashlib.sha256((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    seen, out = set(), {}
    for null, i, _, t in ordered:
        b = t.encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - threshold + 1):
            w = b[p : p + threshold]
            if w in seen:
                gone[p : p + threshold] = True
            seen.add(w)
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone[:-1]])
        out[None if null else i, t] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return collections.Counter((i, *out[i, t or ""]) for i, t in rows)


def test_repeats_match_brute_force(docs):
    got = collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect())
    assert got == brute_repeats(corpus(), 100)


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_long_texts_are_cut_into_pieces(spark, unit):
    rng = random.Random(8)
    vocab = [f"w{k}" for k in range(3000)]
    texts = [[rng.choice(vocab) for _ in range(2500)] for _ in range(3)]
    for a, b in ((100, 900), (600, 40), (690, 2300), (1399, 1750)):
        texts[1][b : b + 130] = texts[0][a : a + 130]
    texts[2][5:2000] = texts[2][10:2005]
    joined = [" ".join(t) for t in texts]
    rows = list(enumerate(joined))
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), unit=unit, threshold=100 if unit == "bytes" else 50, piece=700).collect()
    if unit == "bytes":
        assert collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == brute_repeats(rows, 100)
    else:
        seen, want = set(), {}
        for k, t in enumerate(texts):
            gone = set()
            for p in range(len(t) - 49):
                w = tuple(t[p : p + 50])
                gone |= set(range(p, p + 50)) if w in seen else set()
                seen.add(w)
            want[k] = [w for p, w in enumerate(t) if p not in gone]
        assert {r.id: bytes(r.kept).decode().split() for r in got} == want


def test_repeats_by_words(spark):
    rng = random.Random(5)
    passage = " ".join(f"w{rng.randint(0, 999)}" for _ in range(60))
    rows = [(1, "one two " + passage + " three"), (2, passage), (3, "x " + passage + "\ny"), (4, passage.rsplit(" ", 11)[0])]
    got = {r.id: bytes(r.kept).decode() for r in suffix_dedup.remove_repeats(frame(spark, rows), unit="words", threshold=50).collect()}
    assert got == {1: rows[0][1], 2: "", 3: "x \ny", 4: rows[3][1]}


# ---- decontamination


def brute_overlap(text, item):
    d, b = ([w for w in re.split(r"[^\w]+|_", t.lower()) if w] for t in (text or "", item or ""))
    width = min(13, len(b))
    need = len(b) if len(b) < 9 else width - width * 2 // 13
    for o in range(-len(b), len(d)) if b else ():
        same = [0 <= o + q < len(d) and d[o + q] == b[q] for q in range(len(b))]
        if any(sum(same[a : a + width]) >= need for a in range(len(b) - width + 1)):
            return True
    return False


@pytest.mark.parametrize("few", [False, True])
def test_substituted_overlaps(spark, few):
    rng = random.Random(2)
    vocab = [f"v{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(n))) for k, n in enumerate([13, 20, 40, 13, 9, 9, 10, 11, 12, 8, 8, 3])]
    items += [(50, None), (None, "x " * 20), (51, "What is the capital city of new zealand"), (52, ""), (53, " ".join(rng.choice(vocab) for _ in range(30)) + " " + items[1][1]), (54, "zz")]
    rows = [(900, None), (901, ""), (902, "v1"), (None, items[0][1]), (903, "so: what is the capital city of New Zealand?"), (904, "what is the capital town of new zealand"), (905, "zz"), (906, items[4][1].split(" ", 1)[1])]
    for k in range(240):
        w = [rng.choice(vocab) for _ in range(60)]
        part = items[k % 12][1].split()[:13]
        for at in rng.sample(range(len(part)), min(len(part), rng.randint(0, 4 if len(part) > 12 else 2))):
            part[at] = "changed"
        w[20 : 20 + len(part)] = part
        rows.append((k, " ".join(w).upper() if k % 2 else ", ".join(w)))
    bench = spark.createDataFrame([(i, t, "x") for i, t in [*items, items[1]]], "item_id long, text string, seed string")
    bounds = {"broadcast_seeds": 60, "broadcast_places": 10} if few else {}
    once = {(r.id, r.item_id): r.n_seeds for r in decontaminate.overlaps(frame(spark, rows), bench, **bounds).collect()}
    got = {(r.id, r.item_id): r.n_seeds for r in decontaminate.overlaps(frame(spark, [*rows, *rows[10:40], *rows[10:40]]), bench, **bounds).collect()}
    want = {(i, j) for i, t in rows if i is not None for j, b in items if j is not None and brute_overlap(t, b)}
    assert set(got) == want and len(want) > 100 and got == once
    assert {j for _, j in want} >= {4, 5, 6, 7, 8, 9, 11, 51, 53, 54}
    assert decontaminate.overlaps(frame(spark, rows[:1]).limit(0), bench, **bounds).count() == 0
    assert decontaminate.overlaps(frame(spark, rows), bench.limit(0), **bounds).count() == 0


def test_masks_miss_no_window():
    for a in range(13):
        for b in range(a):
            assert any(all(p + o not in (a, b) for o in mask) for mask in decontaminate.MASKS for p in range(5))


# ---- quality


def brute_base(text):
    w = words_of(text)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    n = collections.Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_base_and_model(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, None) for k in range(40)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    rows = quality.judge(docs, model).collect()
    got = collections.Counter((r.id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows)
    assert got == collections.Counter((i, *brute_base(t)) for i, t in corpus())
    for r in rows:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert 0 <= r.quality <= 1 and r.kept == (not r.base_failed and r.quality >= quality.KEEP_AT)
    assert quality.judge(docs.limit(0), model).count() == 0
    assert all(r.kept != r.base_failed for r in quality.judge(docs, quality.train(docs, labels.limit(0))).collect())


def test_quality_model_on_held_out_rows(spark):
    rng = random.Random(6)
    good, bad = ([f"{c}{k}" for k in range(400)] for c in "gb")
    rows = [(k, " ".join(rng.choice(good if (k % 2 == 0) == (rng.random() < 0.8) else bad) for _ in range(80))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 2 == 0)) for k in range(200)], "doc_id long, quality int")
    got = {r.id: (r.kept, r.quality) for r in quality.judge(docs, quality.train(docs, labels)).collect()}
    assert sum(got[k][0] == (k % 2 == 0) for k in range(200, 400)) >= 190
    # calibrated: the probabilities of held-out rows add up to the share that is good
    assert abs(sum(got[k][1] for k in range(200, 400)) / 200 - 0.5) < 0.1


# ---- toxicity


def test_restorer():
    bigrams = np.ones((28, 28))
    for word in ["idiot", "stupid", "moron", "loser", "trash", "worthless", "pathetic"] * 50:
        codes = [0, *(ord(c) - 96 for c in word), 0]
        for a, b in zip(codes, codes[1:], strict=False):
            bigrams[a, b] += 1
    r = toxicity.Restorer(bigrams)
    assert r.restore(["1d10t", "stuuuupid", "m.o.r.o.n", "l0ser", "tr@sh", "w0rthle$$", ""])[:6] == ["idiot", "stupid", "moron", "loser", "trash", "worthless"]


def test_toxicity_learns_and_sees_through_disguise(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgilmnorstu") for _ in range(5)) for _ in range(80)]
    rows, labels = [], []
    for k in range(300):
        w = [rng.choice(words) for _ in range(30)]
        if k % 4 == 0:
            w[rng.randrange(30)] = rng.choice(["vexor", "grumbol"])
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    rows += [(1000, words[0] + " v3x0r " + words[1]), (1001, "g r u m b o l"), (1002, ""), (1003, None), (1004, "veeeexor"), (None, "x")]
    docs = frame(spark, rows)
    model = toxicity.train(docs, spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int"))
    got = {r.id: r.score for r in toxicity.score(docs, model).collect()}
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert all((got[k] >= 0.7) == (k % 4 == 0) for k in held)
    assert min(got[1000], got[1001], got[1004]) >= 0.7 and max(got[1002], got[1003], got[None]) < 0.7
    nothing = toxicity.train(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(docs, nothing).collect()} == {0.05}


# ---- SentencePiece


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def test_pieces_match_the_library(spark, docs, vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [t for _, t in corpus()] + ["  a  b ", "tabs\tand\r\nlines\n\n", "▁ lower one eighth block ▁▁", "aaaaaaaaaa", "====----", "don't 12345 x_y", "😀é" * 20]
    ids, at = pieces.Encoder(vocabulary).encode(texts)
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == (library.encode(t) if t else [])
    rows = pieces.encode(docs, vocabulary).collect()
    assert pieces.encode(docs.limit(0), vocabulary).count() == 0
    assert len(rows) == len(corpus()) and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows)


def test_long_words_match_the_library(vocabulary):
    sentencepiece = pytest.importorskip("sentencepiece")
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    rng = random.Random(12)
    syllables = ["in", "ter", "na", "tion", "al", "is", "the", "qu", "x", "é", "zz", "ing", "1", "0", "汉", "😀", "ess"]
    words = ["".join(rng.choice(syllables) for _ in range(n)) for n in (3000, 20_000)] + ["a" * 30_000, "ab" * 9000, "".join(rng.choice("abcdefghij") for _ in range(9000))]
    ids, at = pieces.Encoder(vocabulary).encode(words)
    for k, w in enumerate(words):
        assert ids[at[k] : at[k + 1]].tolist() == library.encode(w)


def test_unigram_viterbi_is_optimal(vocabulary):
    import copy

    v = copy.copy(vocabulary)
    v.kind, v.usable = pieces.UNIGRAM, np.ones(len(v.pieces) + 1, bool)
    index = {p: k for k, p in enumerate(v.pieces) if k > 258}

    def best(word):
        top = [0.0] + [float("-inf")] * len(word)
        for j in range(1, len(word) + 1):
            for i in range(max(0, j - v.longest), j):
                if (k := index.get(word[i:j])) is not None:
                    top[j] = max(top[j], top[i] + v.score[k])
        return top[-1]

    encoder = pieces.Encoder(v)
    for word in ["▁internationalisation", "▁the", "▁hello", "▁aaaa"]:
        ids, _ = encoder.encode([word.replace("▁", "")])
        assert sum(v.score[k] for k in ids) == pytest.approx(best(word))


# ---- sharding


def test_shards(docs):
    rows = sharding.shard_rows(docs).collect()
    want = collections.Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus())
    assert collections.Counter((r.id, r.size, r.text_crc32) for r in rows) == want
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1 and len(slots) == 8
    assert [(r.id, r.shard, r.slot) for r in sharding.shard_rows(docs).orderBy("shard", "slot").collect()] == [(r.id, r.shard, r.slot) for r in sorted(rows, key=lambda r: (r.shard, r.slot))]
    assert sharding.shard_rows(docs.limit(0)).count() == 0


def test_shards_are_uniform(spark):
    rows = [(k % 4000, f"t{k % 4000}") for k in range(8000)] + [(9999, "same")] * 4000
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = sharding.shard_rows(docs).select("id", "shard", "slot").collect()
    assert collections.Counter(r.shard for r in got) == {s: 1500 for s in range(8)}
    # 8 shards by 16 classes of ids, and 10 tenths of slots by these classes: chi-square within its 99.99 % bounds
    for cut, n in ((lambda r: r.shard, 8), (lambda r: r.slot * 10 // 1500, 10)):
        seen = np.zeros((16, n))
        for r in got:
            seen[r.id % 15 if r.id < 9999 else 15, cut(r)] += 1
        expected = seen.sum(1, keepdims=True) * seen.sum(0, keepdims=True) / seen.sum()
        chi, free = ((seen - expected) ** 2 / expected).sum(), 15 * (n - 1)
        assert free - 4 * (2 * free) ** 0.5 < chi < free + 5 * (2 * free) ** 0.5


def test_communication_matrix_follows_its_law():
    from math import comb

    draws = np.array([sharding.communication_matrix([4, 6], [5, 5], seed)[0, 0] for seed in range(4000)])
    law = np.array([comb(5, k) * comb(5, 4 - k) / comb(10, 4) for k in range(5)])
    seen = np.bincount(draws, minlength=5)
    assert ((seen - 4000 * law) ** 2 / (4000 * law)).sum() < 23.5  # chi-square, four degrees of freedom, 99.99 %


def test_communication_matrix():
    m = sharding.communication_matrix([10, 0, 7, 1], [6, 6, 6], 1)
    assert m.sum(1).tolist() == [10, 0, 7, 1] and m.sum(0).tolist() == [6, 6, 6]
    rng = np.random.default_rng(0)
    draws = [sharding._hypergeometric(rng, 3 * 10**9, 10**9, 1000) for _ in range(300)]
    assert abs(np.mean(draws) - 750) < 4 and 9 < np.std(draws) < 19


# ---- URL filter


def test_urls(spark):
    urls = [None, "", "no scheme/cheap-pills", "http://A.Example.NET/en/x?y#z", "http://b.net", "http://b.net/", "https://x.example.com/de/1", "http://example.org/fr/", "http://h/casino", "http://h/casinos", "http://cheap.h/pills", "http://cheap.h/cheap", "http://h?win://bonus", "ftp://badexample.net/en/", "http://x\n/sex"]
    pages = spark.createDataFrame([(k, u, "c") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = {r.id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge_urls(pages).collect()}
    assert [got[k][3] for k in range(len(urls))] == ["allow", "allow", "block", "allow", "allow", "block", "block", "allow", "block", "allow", "block", "allow", "block", "block", "block"]
    assert url_filter.judge_urls(pages.limit(0)).count() == 0
    assert got[3] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[4][:3] == ("b.net", "", None) and got[2][:2] == ("", "")


def test_url_weights_and_rules(spark):
    table = spark.createDataFrame([("Bad", None), ("lone", 9), ("soft", 2), ("mild", 1), ("mild", 3), ("weak", 1), ("soft", None), (None, 1), ("", 2)], "term string, weight int")
    strict, soft = url_filter.load_vocabulary(table)
    assert strict == {"bad", "soft"} and soft == {"lone": 9, "mild": 3, "weak": 1}
    with pytest.raises(ValueError):
        url_filter.load_vocabulary(table, most=2)
    urls = ["http://h/lone", "http://h/mild-weak", "http://h/weak-lone", "http://h/weak", "http://h/a-bad-b", "http://h/badly", "http://h/mild/mild", "http://x.y.z/a/b", "http://y.z/a", "http://z/q"]
    rules = [("allow", "z", "/"), ("block", "y.z", "/a"), ("allow", "y.z", "/a/b"), ("block", "nowhere", "/")]
    got = {r.id: (r.verdict, r.rule, r.weight) for r in url_filter.judge_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules=rules, strict={"bad"}, soft=soft, limit=4).collect()}
    assert [got[k][0] for k in range(10)] == ["allow", "block", "block", "allow", "block", "allow", "allow", "allow", "block", "allow"]
    assert got[7][1] == "y.z/a/b" and got[8][1] == "y.z/a" and got[9][1] == "z/" and got[1][2] == 4


# ---- WARC


def test_archive(spark):
    big = "é" * 100_000
    html = [(1, "u1", "a"), (2, "u\r\nX: y", "a"), (3, None, None), (4, "u4", ""), (5, "u5", big), (6, "u6", "x\r\n\r\nWARC/1.1\r\n\r\n0\r\n\r\n"), (7, "u7", big), (7, "u7", big), (None, "n", "a"), (9, "u", "b"), (9, "u", "b")]
    pages = spark.createDataFrame([(*r, "c") for r in html], "page_id long, url string, html string, kind string")
    path = fresh_path(spark, "warc-test")
    warc.archive_pages(pages, path)
    got = collections.Counter()
    for r in warc.read_archive(spark, path, keep_payload=True).collect():
        own = r.record_id.split(":")[2]
        got[own, r.kind, r.refers_to and r.refers_to.split(":")[2], r.status, None if r.payload is None else bytes(r.payload).decode()] += 1
    want = {("2", "response", None, "ok", "a"): 1, ("1", "revisit", "2", "ok", None): 1, ("none", "revisit", "2", "ok", None): 1, ("4", "response", None, "ok", ""): 1, ("3", "revisit", "4", "ok", None): 1,
            ("7", "response", None, "ok", big): 2, ("5", "revisit", "7", "ok", None): 1, ("6", "response", None, "ok", html[5][2]): 1, ("9", "response", None, "ok", "b"): 2}
    assert got == want
    # the rows of the query, by brute force
    bodies = [(i, (t or "").encode()) for i, _, t in html]
    keeper = {b: max((i for i, x in bodies if x == b and i is not None), default=None) for _, b in bodies}
    rows = collections.Counter((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == keeper[b] else "revisit", None if i == keeper[b] else keeper[b], "ok") for i, b in bodies)
    assert collections.Counter(map(tuple, warc.page_records(spark, path).collect())) == rows
    # each record is a gzip member that can be read at its offset
    for name in glob.glob(f"{path.removeprefix('file://')}/part-*"):
        data = open(name, "rb").read()
        at = data.find(b"\x1f\x8b", 30)
        assert list(warc.parse(warc.inflated(data[at:]))) and list(warc.parse(warc.inflated(gzip.decompress(data))))
    empty = fresh_path(spark, "warc-empty")
    warc.archive_pages(pages.limit(0), empty)
    assert warc.page_records(spark, empty).count() == 0


def test_framing_and_lost_segments(spark, tmp_path):
    body = bytes(range(256)) * 50
    assert warc.unchunked(warc.chunked(body, 100)) == body and warc.unchunked(warc.chunked(b"")) == b""
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    assert warc.unchunked(b"5\r\nabc\r\n0\r\n\r\n") is None and warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"") is None
    whole = list(warc._records("urn:a:1:x", "u", None, body, 4000))
    assert len(whole) > 2
    records = {"all": whole[::-1], "first": whole[1:], "middle": whole[:1] + whole[2:], "last": whole[:-1]}
    for name, own in records.items():
        data = b"".join(r.replace(b"urn:a:1:x", f"urn:a:{name}:x".encode()) + warc.TERMINATOR for r in own)
        (tmp_path / f"{name}.gz").write_bytes(gzip.compress(data))
    got = {r.record_id.split(":")[2]: (r.status, r.payload_bytes) for r in warc.read_archive(spark, f"file://{tmp_path}").collect()}
    # a header's length changes with the name, its block does not
    assert got["all"] == ("ok", len(body)) and {got[k][0] for k in ("first", "middle", "last")} == {"bad length"}
    assert warc.digest_of(b"") == base64.b32encode(hashlib.sha1(b"").digest()).decode()


# ---- token totals


def library_counts(version):
    import public_tokenizers
    import tiktoken

    with open(token_rollup.TOKENIZERS[version], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    encode = tiktoken.Encoding(version, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    return lambda t: (len(encode(t or "")), len((t or "").encode()))


def test_rollups(spark):
    rows = [(i, t, None if k % 7 == 0 else "s" + str(k % 2), None if k % 5 == 0 else "en") for k, (i, t) in enumerate(corpus())]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, source string, lang string, tokens int, bytes string")
    one, two = "byte-bpe-50k", "byte-bpe-multi-50k"
    counts = {v: [library_counts(v)(t) for _, t, _, _ in rows] for v in (one, two)}
    odd = [k for k, r in enumerate(rows) if (r[0] or 0) % 2]

    def sums(keep):
        out = collections.Counter()
        for k, v, sign in keep:
            out.update({(rows[k][2], rows[k][3], v, c): sign * n for c, n in zip(("docs", "tokens", "bytes"), (1, *counts[v][k]), strict=True)})
        return {x: n for x, n in out.items() if n}

    def held(store):
        return {(r.source, r.lang, r.tokenizer_version, c): r[c] for r in store.totals().collect() for c in ("docs", "tokens", "bytes") if r[c]}

    counted, again = token_rollup.count_tokens(docs, one), token_rollup.count_tokens(docs, two)
    assert counted.count() == len(rows) and counted.limit(0).count() == 0
    store = token_rollup.RollupStore(spark, fresh_path(spark, "rollup-test"))
    assert store.totals().count() == 0
    assert store.commit("a", token_rollup.inserted(counted)) and not store.commit("a", token_rollup.inserted(counted))
    every = [(k, one, 1) for k in range(len(rows))]
    assert held(store) == sums(every)
    is_odd = F.coalesce(F.col("doc_id"), F.lit(0)) % 2 == 1
    assert store.commit("b", token_rollup.revised(counted.filter(is_odd), again.filter(is_odd)))
    revised = every + [(k, one, -1) for k in odd] + [(k, two, 1) for k in odd]
    assert held(store) == sums(revised)
    # a writer that died: sums without an entry, and an entry that was not renamed
    log = store.path.removeprefix("file://")
    os.makedirs(f"{log}/tmp", exist_ok=True)
    open(f"{log}/tmp/half", "w").write('{"bat')
    token_rollup.deleted(counted).write.parquet(f"{store.path}/deltas/lost")
    assert held(token_rollup.RollupStore(spark, store.path)) == sums(revised)
    # two writers of one batch: the entry names one folder
    other = token_rollup.RollupStore(spark, store.path)
    late = token_rollup.deleted(counted.filter(~is_odd))
    other._log = lambda: (set(), [], 0)
    assert store.commit("c", late) and other.commit("c", late)
    left = revised + [(k, one, -1) for k in range(len(rows)) if k not in odd]
    assert held(store) == sums(left)
    for k in range(3):
        store.compact()
        assert held(token_rollup.RollupStore(spark, store.path)) == sums(left) and not store.commit("b", late)
        assert store.commit(f"more {k}", token_rollup.inserted(counted.limit(0)))
    assert len([n for n in os.listdir(f"{log}/log") if n.startswith(("batch", "base"))]) <= 5
    assert json.load(open(max(glob.glob(f"{log}/log/base-*"))))["folders"]
    assert store.commit("d", token_rollup.deleted(again.filter(is_odd))) and store.totals().count() == 0
