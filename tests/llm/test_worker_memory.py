"""What a Python worker holds while it works, and once it is idle."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa

from leafmill.llm import pieces, suffix_dedup
from leafmill.llm.arrowtext import Roller, released
from leafmill.storage import BATCH_BYTES, bounded_batches


def test_words_are_held_once_however_often_texts_have_them():
    encoder = pieces.Encoder(pieces.load())
    texts = ["the same few words again " * 1000] * 100
    one = encoder.encode(texts[:1])[0]
    tracemalloc.start()
    ids, at = encoder.encode(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.diff(at) == len(one)).all() and (ids.reshape(100, -1) == one).all()
    assert peak < 28e6  # 500 000 words: 56 bytes each


def test_ids_stay_right_when_known_words_are_dropped():
    vocabulary = pieces.load()
    texts = [f"word {k} and wörd{k % 7}, another-{k * k}" for k in range(60)] + [None, ""]
    ids, at = pieces.Encoder(vocabulary).encode(texts)
    small = pieces.Encoder(vocabulary, most=0)
    for k, text in enumerate(texts):
        assert small.encode([text])[0].tolist() == ids[at[k] : at[k + 1]].tolist()


def test_idle_workers_keep_no_powers():
    list(released(iter([Roller(np.ones(5000, np.uint64), 3)])))
    assert not Roller._powers


def test_filing_windows_holds_a_bounded_number_of_records():
    texts = [" ".join(f"w{(k * 7919 + j * 104729) % 100003}" for j in range(3000)) for k in range(4500)]

    class Kept:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    batches = pa.table({"doc": list(range(len(texts))), "text": texts}).to_batches(max_chunksize=100)
    run = suffix_dedup.file_documents(Kept(), "words", 50)
    tracemalloc.start()
    rows = sum(b.num_rows for b in run(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows and peak < 80e6


def test_stages_read_batches_of_bounded_bytes(spark):
    spark.conf.unset(BATCH_BYTES)
    docs = spark.createDataFrame([(k, "many words " * 20_000) for k in range(100)], "doc_id long, text string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows], "size": [batch.nbytes]})

    try:
        bounded_batches(spark)
        found = docs.mapInArrow(sizes, "n long, size long").collect()
        assert sum(r.n for r in found) == 100 and max(r.size for r in found) < 5e6
        spark.conf.set(BATCH_BYTES, 1 << 20)
        bounded_batches(spark)
        assert int(spark.conf.get(BATCH_BYTES)) == 1 << 20
    finally:
        spark.conf.unset(BATCH_BYTES)
