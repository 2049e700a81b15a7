"""Pictures are worked on one at a time, so that a worker's memory does not grow with the rows of a batch."""

import numpy as np

from leafmill.plans import plugins
from leafmill.sources.pixels import encode


def test_samples_are_told_row_by_row(spark):
    pixels = np.arange(6, dtype=np.uint8).reshape(2, 3, 1)
    rows = [(n, bytearray(encode(pixels)) if n % 3 else None) for n in range(30)]
    told = plugins.samples_of(spark.createDataFrame(rows, "doc_id long, png binary"))
    assert "ArrowEvalPython" not in told._jdf.queryExecution().executedPlan().toString()
    assert {r.doc_id: r.samples for r in told.collect()} == {n: "000102030405" if n % 3 else None for n in range(30)}
