"""What the layout and the reading do once, and that it is still the same."""

import re

import pytest
from pyspark.sql import functions as F

from leafmill.functions.text import clean_line, plain, strip
from leafmill.operators import layout, reading
from leafmill.plans import catalog

SMALL = "/root/testdata/sf0.001"
SPACES = [c for c in map(chr, [*range(0x3100), 0xFEFF]) if not 0xD800 <= ord(c) < 0xE000]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_white_space_of_every_kind_is_stripped_as_the_pattern_did(spark):
    rows = [(f"{c}{c} a{c}b {c}",) for c in SPACES] + [("",), (" \n",), ("a\r\n",), (None,)]
    own = spark.createDataFrame(rows, "text string")
    wrong = own.filter(~strip(F.col("text")).eqNullSafe(F.regexp_replace("text", r"(?U)^\s+|\s+$", "")))
    assert wrong.count() == 0
    assert "regexp" not in plan(own.select(strip(F.col("text")), clean_line(F.col("text")), plain(F.col("text"))))


def test_typographic_characters_are_made_plain(spark):
    own = spark.createDataFrame([("⁄’‘“”•- “a”",)], "text string")
    assert own.select(plain(F.col("text"))).first()[0] == "/''\"\"·- \"a\""


def ordered(spark, rows):
    """Elements ``(page_no, label, text, column)`` in reading order."""
    kinds = {"table": "table", "picture": "figure"}
    full = [(1, seq, p, 100 + seq, label, kinds.get(label, "text"), text, column, 1.0, 2.0, 3.0, 4.0, 10.0) for seq, (p, label, text, column) in enumerate(rows)]
    return spark.createDataFrame(full, "doc_id long, seq int, page_no int, id int, label string, kind string, text string, column int, l double, t double, r double, b double, height double")


ROWS = [
    (1, "caption", "one", 0), (1, "table", "", 0), (1, "caption", "two", 0), (1, "footnote", "x", 0), (1, "code", "c", 0), (1, "footnote", "y", 0), (1, "footnote", "z", 0),
    (1, "list_item", "- a", 0), (1, "picture", "", 0), (1, "list_item", "- b", 0), (1, "text", "goes", 0), (1, "text", "on here", 1), (2, "text", "and ends.", 0),
    (2, "footnote", "alone", 0), (2, "list_item", "- c", 0), (2, "caption", "last", 0), (3, "table", "", 0), (3, "footnote", "of it", 0), (4, "footnote", "not of it", 0),
]


def test_links_of_items(spark):
    got = {r.seq: r for r in reading.items(ordered(spark, ROWS)).collect()}
    assert sorted(got) == [s for s in range(len(ROWS)) if s not in (11, 12)]
    # the caption right after the table is taken by the code only if that comes next; a footnote stands between
    assert got[1].caption_refs == ["#/1/100", "#/1/102"] and got[0].parent_ref == got[2].parent_ref == "#/1/101"
    assert got[4].footnote_refs == ["#/1/105", "#/1/106"] and got[5].parent_ref == "#/1/104" and got[5].footnote_refs == []
    assert got[3].parent_ref is None and got[13].parent_ref is None and got[15].parent_ref is None and got[18].parent_ref is None
    assert got[16].footnote_refs == ["#/3/117"]
    assert [got[s].parent_ref for s in (7, 9, 14)] == ["#/groups/0", "#/groups/0", "#/groups/1"]
    assert got[10].text == "goes on here and ends." and [(p.page_no, p.start, p.end) for p in got[10].prov] == [(1, 0, 4), (1, 5, 12), (2, 13, 22)]
    assert [(p.start, p.end, p.t, p.b) for p in got[14].prov] == [(0, 3, 8.0, 6.0)] and got[14].text == "c" and got[14].marker == "-"


def test_links_take_no_texts_along(spark):
    assert not re.search(r"Window \[[^\n]*\btext#", plan(reading.items(ordered(spark, ROWS))))


@pytest.mark.parametrize("name", ["caption_links", "footnote_links", "list_groups", "reading_order"])
def test_what_needs_no_texts_joins_none(spark, name):
    assert "array_join" not in plan(catalog.QUERIES[name](spark, SMALL))


def test_texts_are_split_into_cells_once(spark):
    assert "split(text" not in plan(catalog.QUERIES["children_emit"](spark, SMALL))


def test_boxes_of_overlaps_are_dealt_once(spark):
    rows = [(1, 1, i, "regular", False, float(i % 7), float(i % 5), float(i % 7 + 9), float(i % 5 + 9)) for i in range(40)]
    own = spark.createDataFrame(rows, "doc_id long, page_no int, id int, cls string, is_orphan boolean, l double, t double, r double, b double")
    pairs = layout.overlap_pairs(own)
    assert pairs._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert pairs.count() == pairs.distinct().count() > 0


def test_texts_of_grid_tables_are_read_once(spark):
    own = plan(catalog.QUERIES["grid_tables"](spark, SMALL))
    assert "split(" not in own and own.count("LogicalRDD") + own.count("Relation [") <= 4
