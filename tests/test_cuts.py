import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from leafmill.config import Options, ReadingOptions
from leafmill.operators import cuts
from leafmill.plans import engine
from leafmill.sources import text_pages as tp


def groups(spans):
    """Index lists of intervals that overlap, along the axis: joined until nothing changes."""
    parts = [[k] for k in range(len(spans))]
    joined = True
    while joined:
        joined = False
        for a in range(len(parts)):
            for b in range(a + 1, len(parts)):
                la, ha = min(spans[k][0] for k in parts[a]), max(spans[k][1] for k in parts[a])
                lb, hb = min(spans[k][0] for k in parts[b]), max(spans[k][1] for k in parts[b])
                if max(la, lb) < min(ha, hb):
                    parts[a] += parts.pop(b)
                    joined = True
                    break
            if joined:
                break
    return sorted((sorted(p) for p in parts), key=lambda p: min(spans[k][0] for k in p))


def plain_order(boxes, heading):
    """The same rules told on lists of boxes."""

    def read(own):
        if len(own) < 2:
            return own
        xs = lambda ks: [(boxes[k][0], boxes[k][2]) for k in ks]
        ys = lambda ks: [(boxes[k][1], boxes[k][3]) for k in ks]
        across = [[own[k] for k in part] for part in groups(xs(own))]
        if len(across) > 1:
            tall = [(min(y for y, _ in ys(p)), max(y for _, y in ys(p))) for p in across]
            bands = groups(tall)
            if len(bands) == 1:
                return [k for p in across for k in read(p)]
            return [k for band in bands for k in read(sorted(k for n in band for k in across[n]))]
        bands = [[own[k] for k in part] for part in groups(ys(own))]
        if len(bands) == 1:
            return sorted(own, key=lambda k: (boxes[k][1], boxes[k][0], k))
        sections = [[bands[0]]]
        for band in bands[1:]:
            together = [k for b in sections[-1] for k in b] + band
            if len(groups(xs(together))) > 1:
                sections[-1].append(band)
            else:
                sections.append([band])
        final = []
        for n, section in enumerate(sections):
            tail = []
            while n < len(sections) - 1 and len(section) > 1 and len(groups(xs(section[-1]))) == 1 and all(heading[k] for k in section[-1]):
                tail.insert(0, [section.pop()])
            final += ([section] if any(len(groups(xs(b))) > 1 for b in section) else [[b] for b in section]) + tail
        return [k for section in final for k in read(sorted(k for b in section for k in b))]

    return read(list(range(len(boxes))))


BOX = st.tuples(st.integers(0, 12), st.integers(0, 12), st.integers(1, 6), st.integers(1, 4)).map(lambda b: (b[0], b[1], b[0] + b[2], b[1] + b[3]))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(BOX, st.booleans()), min_size=0, max_size=14))
def test_order_equals_the_plain_one(rows):
    boxes, heading = [b for b, _ in rows], [h for _, h in rows]
    place, column = cuts.page_order(np.array(boxes, dtype=float), np.array(heading, dtype=bool))
    assert list(np.argsort(place)) == plain_order(boxes, heading)
    assert sorted(place) == list(range(len(rows))) and (np.diff(column[np.argsort(place)]) >= 0).all()


def names(*boxes, heading=()):
    place, column = cuts.page_order(np.array([b[1:] for b in boxes], dtype=float), np.array([b[0] in heading for b in boxes]), 1.0)
    order = np.argsort(place)
    return "".join(boxes[k][0] for k in order), [int(column[k]) for k in order]


def test_aligned_lines_are_not_read_across():
    assert names(("a", 0, 0, 90, 10), ("c", 100, 0, 190, 10), ("b", 0, 20, 90, 30), ("d", 100, 20, 190, 30), ("t", 0, -20, 190, -10)) == ("tabcd", [0, 1, 1, 2, 2])


def test_short_heading_belongs_to_what_follows():
    page = [("a", 0, 0, 90, 20), ("b", 100, 0, 190, 20), ("h", 0, 30, 60, 40), ("w", 0, 50, 190, 60)]
    assert names(*page, heading="h")[0] == "abhw" and names(*page)[0] == "ahbw"


def test_label_and_value_lines_are_read_down_the_page():
    assert names(("b", 100, 0, 190, 10), ("a", 0, 20, 90, 30))[0] == "ba"


def test_boxes_that_touch_a_little_have_a_gutter():
    assert names(("a", 0, 0, 101, 10), ("c", 100, 0, 190, 10), ("b", 0, 12, 101, 20), ("d", 100, 12, 190, 20), ("t", 0, -20, 190, -10))[0] == "tabcd"


def test_rows_without_sides_and_repeated_rows(spark):
    schema = "doc_id long, page_no int, id int, label string, l double, t double, r double, b double, width double"
    rows = [(1, 1, 5, None, 0.0, 0.0, 9.0, 9.0, 1.0), (1, 1, 5, None, 0.0, 0.0, 9.0, 9.0, 1.0), (1, 1, 2, "text", None, 0.0, 9.0, 9.0, 1.0), (1, 1, 3, "page_footer", 0.0, 0.0, 9.0, 9.0, 1.0), (1, 1, 4, "page_header", 0.0, 50.0, 9.0, 59.0, 1.0), (2, 1, 1, "text", 0.0, 0.0, 9.0, 9.0, 1.0)]
    pages = spark.createDataFrame([(1, 1, 99.0, 99.0)], "doc_id long, page_no int, width double, height double")
    got = cuts.reading_order(spark.createDataFrame(rows, schema).drop("width"), pages).orderBy("doc_id", "seq").collect()
    assert [(r.doc_id, r.id, r.seq, r.zone) for r in got] == [(1, 4, 0, 0), (1, 5, 1, 1), (1, 5, 2, 1), (1, 2, 3, 1), (1, 3, 4, 2), (2, 1, 0, 1)]
    assert cuts.reading_order(spark.createDataFrame([], schema).drop("width"), pages).count() == 0


def test_a_page_of_many_blocks_is_ordered_soon():
    import time

    rng = np.random.default_rng(1)
    column, row = np.divmod(rng.permutation(6000), 1500)
    boxes = np.stack([column * 100.0, row * 10.0, column * 100.0 + 90, row * 10.0 + 8], axis=1)
    began = time.perf_counter()
    place, _ = cuts.page_order(boxes, np.zeros(6000, dtype=bool))
    assert (place == column * 1500 + row).all() and time.perf_counter() - began < 5


def test_the_engine_reads_by_cuts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("doc_id < 4").withColumn("text", F.col("text"))
    elements, pages = tp.drawn_columns(docs)
    inputs = elements.groupBy("doc_id").agg(F.max("page_no").alias("page_count")).withColumns({"file": F.concat(F.lit("d"), F.col("doc_id"), F.lit(".pdf")), "filesize": F.lit(9)})
    cells = elements.select("doc_id", "page_no", F.col("id").alias("idx"), F.concat(F.lit("Block."), F.col("id")).alias("text"), *"ltrb", F.lit(False).alias("from_ocr"), F.lit(1.0).alias("conf"))
    dets = elements.select("doc_id", "page_no", "id", F.lit("text").alias("label"), *"ltrb", F.lit(0.9).alias("conf"))
    made = engine.Engine(Options(reading=ReadingOptions("cuts"), raises_on_error=False)).convert_all(inputs, cells, dets, pages.withColumn("backend_ok", F.lit(True)))
    got = made.items.select("doc_id", "seq", "item_ref").orderBy("doc_id", "seq").collect()
    assert got and [r.item_ref for r in got] == [f"#/{r.seq // 13 + 1}/{(r.seq % 13 * 7 + 3) % 13}" for r in got]
    with pytest.raises(ValueError, match="no reading order"):
        ReadingOptions("rows")
