import pytest

from leafmill.operators import layout, ocr, status
from leafmill.operators.graph import connected_components

CLUSTER = "doc_id long, page_no int, id int, label string, l double, t double, r double, b double, conf double, cells array<struct<idx:int,l:double,t:double,r:double,b:double>>, is_orphan boolean, ord int, cls string"


def clusters(spark, rows):
    return spark.createDataFrame([(1, 1, i, label, *map(float, box), conf, [], orphan, i, "regular") for i, (label, box, conf, orphan) in enumerate(rows)], CLUSTER)


def kept(spark, *rows):
    return sorted(r.id for r in layout.merged(clusters(spark, rows)).collect())


def test_larger_box_wins_unless_unsure(spark):
    assert kept(spark, ("text", (0, 0, 10, 10), 0.9, False), ("text", (0, 0, 10, 11), 0.9, False)) == [1]
    assert kept(spark, ("text", (0, 0, 10, 10), 0.9, False), ("text", (0, 0, 10, 11), 0.6, False)) == [0]


@pytest.mark.parametrize(("width", "winner"), [(85, [0]), (82, [1])])
def test_list_item_over_text_of_like_size(spark, width, winner):
    # by size and confidence alone the item would yield
    assert kept(spark, ("list_item", (0, 0, 100, 10), 0.6, False), ("text", (0, 0, width, 10), 0.9, False)) == winner


def test_code_over_what_it_holds(spark):
    assert kept(spark, ("code", (0, 0, 100, 100), 0.5, False), ("text", (0, 0, 90, 95), 0.95, False)) == [0]


def test_orphans_never_merge(spark):
    assert kept(spark, ("text", (0, 0, 10, 10), 0.9, True), ("text", (0, 0, 10, 10), 0.9, True)) == [0, 1]


def test_empty_boxes_never_overlap(spark):
    assert kept(spark, ("text", (0, 0, 0, 10), 0.9, False), ("text", (0, 0, 0, 10), 0.9, False)) == [0, 1]


def test_ties_in_assignment_go_to_the_first(spark):
    cells = spark.createDataFrame([(1, 1, 0, "x", 0.0, 0.0, 10.0, 10.0), (1, 1, 1, "  ", 0.0, 0.0, 10.0, 10.0)], "doc_id long, page_no int, idx int, text string, l double, t double, r double, b double")
    dets = spark.createDataFrame([(1, 1, 3, 0.0, 0.0, 20.0, 20.0), (1, 1, 2, 0.0, 0.0, 20.0, 20.0)], "doc_id long, page_no int, id int, l double, t double, r double, b double")
    assert [tuple(r) for r in layout.assign_cells(dets, cells).select("idx", "id").collect()] == [(0, 2)]


@pytest.mark.parametrize(("height", "n"), [(90.0, 1), (90.1, 0)])
def test_full_page_pictures_go(spark, height, n):
    pages = spark.createDataFrame([(1, 1, 100.0, 100.0)], "doc_id long, page_no int, width double, height double")
    pics = spark.createDataFrame([(1, 1, "picture", 0.0, 0.0, 100.0, height)], "doc_id long, page_no int, label string, l double, t double, r double, b double")
    assert layout.not_full_page(pics, pages).count() == n


def test_touching_ocr_cells_are_covered(spark):
    schema = "doc_id long, page_no int, idx int, l double, t double, r double, b double"
    own = spark.createDataFrame([(1, 1, 0, 0.0, 0.0, 10.0, 10.0)], schema)
    read = spark.createDataFrame([(1, 1, 0, 10.0, 10.0, 20.0, 20.0), (1, 1, 1, 11.0, 10.0, 20.0, 20.0)], schema)
    assert [r.idx for r in ocr.without_covered(read, own).collect()] == [1]


def test_status(spark):
    rows = [(1, 1, True, None), (2, 1, False, "x"), (3, 1, True, None), (3, 2, False, None), (4, 0, False, "y")]
    pages = spark.createDataFrame(rows, "doc_id long, page_no int, ok boolean, error string")
    got = {r.doc_id: r.status for r in status.document_status(pages).collect()}
    assert got == {1: "success", 2: "failure", 3: "partial_success", 4: "failure"}
    errors = {r.doc_id: r.errors[0].error_message for r in status.page_errors(pages).collect()}
    assert errors == {2: "Page 1: x", 3: "Page 2: unknown error", 4: "Unknown page: y"}


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 5), (None, 4), (2, 1)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "src long, dst long")
    got = {r.node: r.component for r in connected_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, **{100 + i: 100 for i in range(41)}}
    assert connected_components(df.limit(0)).count() == 0
