"""Rows, columns and spans of tables that are only texts on a page."""

from __future__ import annotations

import random

from leafmill.config import GridOptions, Options
from leafmill.operators import tables
from leafmill.plans.engine import Engine

CELL = "doc_id long, page_no int, idx int, text string, l double, t double, r double, b double"
CLUSTER = "doc_id long, page_no int, id int, cells array<struct<idx:int,l:double,t:double,r:double,b:double>>"


def run(spark, pages: dict[int, list[tuple]]):
    """pages: texts ``(text, l, t, r, b)`` of a table on each page."""
    cells = spark.createDataFrame([(1, no, k, x[0], *map(float, x[1:])) for no, own in pages.items() for k, x in enumerate(own)], CELL)
    clusters = spark.createDataFrame([(1, no, 5, [(k, *map(float, x[1:])) for k, x in enumerate(own)]) for no, own in pages.items()], CLUSTER)
    found = tables.grid(clusters, cells)
    out: dict[int, list] = {no: [] for no in pages}
    for r in found.orderBy("page_no", "row", "col").collect():
        out[r.page_no].append((r.row, r.col, r.col_span, r.text))
    return out, {r.page_no: (r.num_rows, r.num_cols, round(r.score, 3)) for r in tables.predicted(found).collect()}


def test_generated_tables(spark):
    rng = random.Random(3)
    pages, want = {}, {}
    for no in range(1, 26):
        n_rows, n_cols = rng.randrange(3, 12), rng.randrange(1, 6)
        widths = [rng.randrange(40, 90) for _ in range(n_cols)]
        lefts = [20 + sum(widths[:k]) + 25 * k for k in range(n_cols)]
        texts, rows = [], []
        span = rng.randrange(n_cols) if n_cols > 1 else 0
        for row in range(n_rows):
            top = 50 + 18 * row + rng.uniform(-1, 1)
            col = 0
            while col < n_cols:
                wide = span + 1 if row == 0 and col == 0 and span else 1
                if row > 0 and col > 0 and rng.random() < 0.15:
                    col += 1
                    continue
                left, right = lefts[col], lefts[col + wide - 1] + widths[col + wide - 1]
                own = rng.uniform(0.6, 1.0) * widths[col] if wide == 1 else right - left
                shift = rng.choice((0, widths[col] - own)) if wide == 1 else 0
                texts.append((f"r{row}c{col}", left + shift, top, left + shift + own, top + 11))
                rows.append((row, col, wide, f"r{row}c{col}"))
                col += wide
        # every column stands in two rows at least
        if all(sum(c <= k < c + w for _, c, w, _ in rows) >= 3 for k in range(n_cols)):
            rng.shuffle(texts)
            pages[no], want[no] = texts, rows
    assert len(pages) > 12
    got, sizes = run(spark, pages)
    assert got == want
    assert all(sizes[no][:2] == (rows[-1][0] + 1, max(c + w for _, c, w, _ in rows)) for no, rows in want.items())


def test_small_and_odd_tables(spark):
    pages = {
        1: [("only", 10, 10, 40, 20)],
        2: [("a", 10, 10, 40, 20), ("b", 60, 10, 90, 20)],
        3: [("a", 10, 10, 40, 20), ("b", 60, 11, 90, 21), ("c", 10, 30, 95, 40)],
        4: [(" ", 0, 0, 9, 9), ("x", 10, 10, 10, 20)],
        5: [("two", 10, 10, 28, 20), ("words", 30, 10, 60, 20), ("z", 100, 10, 120, 20), ("below", 10, 30, 60, 40), ("q", 100, 30, 120, 40), ("k", 10, 50, 50, 60), ("w", 100, 50, 110, 60)],
    }
    got, sizes = run(spark, pages)
    assert got[1] == [(0, 0, 1, "only")] and got[2] == [(0, 0, 1, "a"), (0, 1, 1, "b")] and got[4] == []
    assert got[3] == [(0, 0, 1, "a b"), (1, 0, 1, "c")]  # of two rows, none may cross a gap
    assert got[5] == [(0, 0, 1, "two words"), (0, 1, 1, "z"), (1, 0, 1, "below"), (1, 1, 1, "q"), (2, 0, 1, "k"), (2, 1, 1, "w")]
    assert sizes[5] == (3, 2, 1.0) and 4 not in sizes


def test_engine_scores_tables(spark):
    texts = [(f"r{r}c{c}", 20.0 + 100 * c, 50.0 + 20 * r, 80.0 + 100 * c, 60.0 + 20 * r) for r in range(4) for c in range(3)]
    cells = spark.createDataFrame([(1, 1, k, *x, False, 1.0) for k, x in enumerate(texts)], CELL + ", from_ocr boolean, conf double")
    found = spark.createDataFrame([(1, 1, 0, "table", 10.0, 40.0, 300.0, 130.0, 0.9)], "doc_id long, page_no int, id int, label string, l double, t double, r double, b double, conf double")
    inputs = spark.createDataFrame([(1, "a.pdf", 10, 1)], "doc_id long, file string, filesize long, page_count int")
    pages = spark.createDataFrame([(1, 1, 612.0, 792.0, True)], "doc_id long, page_no int, width double, height double, backend_ok boolean")
    made = Engine(Options(table=GridOptions())).convert_all(inputs, cells, found, pages)
    item = made.items.filter("type = 'table'").collect()[0]
    assert (item.num_rows, item.num_cols) == (4, 3) and made.confidence.collect()[0].table_score == 1.0
