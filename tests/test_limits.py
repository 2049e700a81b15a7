"""Timings that the engine takes, and a limit on the wall clock."""

from __future__ import annotations

import time

import pytest

from leafmill.config import Options
from leafmill.plans.engine import Engine
from leafmill.sources import text_pages as tp


@pytest.fixture(scope="module")
def given(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 12")
    cells = tp.cells(docs)
    return tp.admission(docs), cells, tp.detections(cells), tp.page_dim(cells)


def test_timings_are_measured(given):
    began = time.perf_counter()
    made = Engine(Options(raises_on_error=False)).convert_all(*given)
    whole = time.perf_counter() - began
    took = {r.key: r for r in made.timings.collect()}
    assert list(took) == ["page-outcome", "merged-cells", "final-clusters", "reading-order"] and all(r.elapsed > 0 for r in took.values())
    assert 0.5 * whole < sum(r.elapsed for r in took.values()) <= whole
    assert took["final-clusters"].n_rows >= took["reading-order"].n_rows >= made.items.count() > 0


def test_a_hanging_stage_ends_as_partial_success(spark, given):
    inputs, cells, detections, pages = given

    def hang(batches):
        for batch in batches:
            time.sleep(600)
            yield batch

    stuck = detections.mapInPandas(hang, detections.schema)
    began = time.perf_counter()
    made = Engine(Options(wall_clock_limit=8.0, raises_on_error=False)).convert_all(inputs, cells, stuck, pages)
    rows = made.results.collect()
    assert time.perf_counter() - began < 120
    admitted = [r for r in rows if r.status != "skipped"]
    assert len(rows) == inputs.count() and admitted and {r.status for r in admitted} == {"partial_success"}
    assert all(len(r.errors) == r.page_count and r.errors[0].error_message == "Page 1: wall-clock limit exceeded" for r in admitted)
    assert made.items.count() == 0 and spark.range(5).count() == 5
    done = Engine(Options(wall_clock_limit=600.0, raises_on_error=False)).convert_all(*given)
    assert done.items.count() > 0 and "success" in {r.status for r in done.results.collect()}
