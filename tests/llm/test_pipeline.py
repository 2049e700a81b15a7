"""The pipeline on a small folder of tables: what each stage must drop and keep."""

from __future__ import annotations

import collections
import random

import pytest

from leafmill.llm import pipeline as leaf


def test_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghiklmnoprstuw") for _ in range(rng.randint(3, 8))) for _ in range(900)]

    def text(n):
        return " ".join(rng.choice(vocab) for _ in range(n))

    rows = [(k, text(150)) for k in range(60)]
    toxic = [(100 + k, text(60) + " vexor " + text(60)) for k in range(24)]
    copy = (200, rows[0][1])
    near = (201, rows[1][1].replace(rows[1][1].split()[70], "changed", 1))
    passage = text(70)
    repeats = [(202, text(100) + " " + passage), (203, text(100) + " " + passage + " " + text(20))]
    item = text(40)
    leak = (204, text(80) + " " + item + " " + text(80))
    odd = [(205, None), (206, "")]
    every = rows + toxic + [copy, near, *repeats, leak, *odd]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in every], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in rows] + [(i, 1, 1) for i, _ in toxic]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
    clean = {i for i, _ in rows}
    assert clean <= kept[0] and not kept[0] & {i for i, _ in toxic}
    assert kept[1] == kept[0] - {200, 201, 206} or kept[1] == kept[0] - {200, 201, 205, 206} | {205}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/2").collect()}
    assert passage in texts[202] and passage not in texts[203] and texts[5] == rows[5][1]
    assert kept[3] == kept[2] - {204} and clean <= kept[3]
    assert kept[4] == kept[3] and all(r.round_trip for r in docs.collect())


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, fp string, row string, score double"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", None, None if t is None else len(t), 1, "d", "f", "r", 0.5) for i, t in rows], SCHEMA)


def pairs(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def side_tables(spark, tmp_path_factory):
    """Labels that know one toxic word, and a benchmark of one item."""
    where = str(tmp_path_factory.mktemp("side"))
    rng = random.Random(3)
    item = " ".join(f"b{rng.randrange(999)}" for _ in range(30))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(150)] + [(None, 1), (7, None)], "doc_id long, toxic int").write.parquet(f"{where}/labels.parquet")
    return where, item


def test_rows_are_told_apart_in_repeats(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, "a " + passage), (5, "keep me whole"), (5, "tail " + passage), (None, "z " + passage), (None, None), (6, ""), (5, "keep me whole")]
    got = pairs(leaf.drop_repeats(spark, table(spark, rows), ""))
    # of one id, texts are ordered by their digests; those without an id come last
    assert got == collections.Counter([(1, rows[0][1]), (5, "keep me whole"), (5, "tail "), (None, "z "), (None, None), (6, ""), (5, "keep me whole")])
    out = leaf.drop_repeats(spark, table(spark, rows), "")
    assert out.columns == table(spark, rows).columns and {r.n_chars for r in out.filter("text = 'tail '").collect()} == {5}
    assert leaf.drop_repeats(spark, table(spark, []), "").count() == 0
    long = " ".join(f"l{k}" for k in range(300_000))
    assert pairs(leaf.drop_repeats(spark, table(spark, [(1, long), (2, "x " + long)]), "")) == collections.Counter([(1, long), (2, "x ")])


def test_rows_are_told_apart_in_decontamination(spark, side_tables):
    where, item = side_tables
    rows = [(1, "some " + item), (1, "clean text"), (None, "pre " + item), (None, "clean too"), (2, None), (3, ""), (4, "clean text"), (5, "word " * 200_000 + item)]
    out = leaf.decontaminate(spark, table(spark, rows), where)
    assert pairs(out) == collections.Counter(x for x in rows if item not in (x[1] or "")) and out.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")
    assert leaf.decontaminate(spark, table(spark, []), where).count() == 0


def test_rows_are_told_apart_in_toxicity(spark, side_tables):
    where, _ = side_tables
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgilmnorstu") for _ in range(5)) for _ in range(80)]

    def text(bad):
        w = [rng.choice(words) for _ in range(30)]
        return " ".join([*w[:15], "vexor" if bad else "x", *w[15:]])

    rows = [(k, text(k % 3 == 0)) for k in range(150)]
    odd = [(400, text(True)), (400, text(False)), (None, text(True)), (None, text(False)), (401, None), (402, ""), (403, text(False)), (403, rows[1][1]), (404, "fine " * 100_000)]
    out = leaf.drop_toxic(spark, table(spark, rows + odd + odd[:2]), where)
    assert pairs(out) == collections.Counter(x for x in rows + odd + odd[:2] if "vexor" not in (x[1] or "")) and out.columns == table(spark, []).columns
    assert leaf.drop_toxic(spark, table(spark, []), where).count() == 0


def test_rows_are_told_apart_in_near_copies(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(9999)}" for _ in range(100)) for _ in range(4)]
    near = texts[1].rsplit(" ", 1)[0] + " other"
    rows = [(1, texts[0]), (1, texts[1]), (2, near), (3, texts[0]), (None, texts[2]), (None, texts[2]), (4, texts[3]), (4, texts[3]), (5, None), (6, ""), (None, " \n")]
    out = leaf.drop_near_copies(spark, table(spark, rows), "")
    assert pairs(out) == collections.Counter([(1, texts[0]), (1, texts[1]), (None, texts[2]), (4, texts[3]), (5, None)]) and out.columns == table(spark, []).columns
    assert leaf.drop_near_copies(spark, table(spark, []), "").count() == 0


def test_encoding_keeps_every_row(spark):
    rows = [(1, "a b"), (1, "c"), (None, "a b"), (1, "a b"), (2, None), (3, ""), (4, "word " * 100_000)]
    out = leaf.encode_pieces(spark, table(spark, rows), "").collect()
    assert collections.Counter(r.doc_id for r in out) == collections.Counter(i for i, _ in rows)
    assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out) and {r.n_tokens for r in out if r.doc_id in (2, 3)} == {0}
    assert leaf.encode_pieces(spark, table(spark, []), "").count() == 0
