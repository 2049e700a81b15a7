import pytest
from pyspark.sql import functions as F

from leafmill.config import Limits, Options
from leafmill.functions import geometry, scores, text
from leafmill.sources import formats


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_quality(spark):
    rows = [("plain",), ("a�",), ("GLYPH<0A>",), ("x /G1/G2",), ("/ab /cd x",), ("x /ab /cd",), ("a/ab.cd/ef.gh b/x.y/z.w c/i.j/k.l",), (None,)]
    got = values(spark, text.quality(F.col("t")), rows, "t string")
    assert got[:6] == [1.0, 0.0, 0.0, 0.0, 0.0, 1.0] and got[6] == pytest.approx(0.7)


def test_joined(spark):
    rows = [(["one “line”"],), (["hyphen-", "ated word"],), (["keep-", "_x"],), (["a", "b"],), ([],)]
    got = values(spark, text.joined(F.col("x")), rows, "x array<string>")
    assert got == ["one “line”", "hyphenated word", "keep-_x", "a b", ""]


def test_grades_put_missing_scores_first(spark):
    rows = [(None,), (float("nan"),), (0.95,), (0.85,), (0.5,), (0.1,)]
    assert values(spark, scores.grade(F.col("s")), rows, "s double") == ["unspecified", "unspecified", "excellent", "good", "fair", "poor"]
    assert values(spark, scores.coerced(F.col("s")), [("nan",), ("",), ("0.5",), ("none",), (None,)], "s string") == [None, None, 0.5, None, None]


def test_quantile_skips_missing_scores(spark):
    row = spark.createDataFrame([(0.4, None, 1.0)], "a double, b double, c double")
    mean, low = row.select(scores.mean_of(F.col("a"), F.col("b"), F.col("c")), scores.quantile_of(0.05, F.col("a"), F.col("b"), F.col("c"))).first()
    assert mean == pytest.approx(0.7) and low == pytest.approx(0.43)


def test_boxes(spark):
    rows = [(0.0, 0.0, 10.0, 10.0, 10.0, 0.0, 20.0, 10.0), (0.0, 0.0, 0.0, 10.0, 0.0, 0.0, 5.0, 5.0)]
    df = spark.createDataFrame(rows, "al double, at double, ar double, ab double, bl double, bt double, br double, bb double")
    a, b = geometry.box("a"), geometry.box("b")
    got = df.select(geometry.touches(a, b), geometry.overlaps(a, b), geometry.over_self(a, b)).collect()
    assert tuple(got[0]) == (True, False, 0.0) and got[1][1] is False and got[1][2] is None


@pytest.mark.parametrize(
    ("name", "stream", "expected"),
    [("a.xml", False, "xml_jats"), ("a.txt", False, "xml_jats"), ("a.PDF", False, "xml_uspto"), ("a.PDF", True, "pdf"), ("a.tar.gz", False, "xml_uspto"), ("none", False, "xml_uspto"), ("a.png", False, "image")],
)
def test_formats(spark, name, stream, expected):
    assert values(spark, formats.detect_format(F.col("n"), stream=stream)[1], [(name,)], "n string") == [expected]


def test_magic_bytes_win(spark):
    df = spark.createDataFrame([("a.txt", bytearray(b"%PDF-1.7")), ("a.txt", bytearray(b"\x1f\x8b\x08"))], "n string, c binary")
    assert [tuple(r) for r in df.select(*formats.detect_format(F.col("n"), F.col("c"))).collect()] == [("application/pdf", "pdf"), ("application/gzip", None)]


def test_page_range():
    with pytest.raises(ValueError):
        Limits(page_range=(5, 3))
    assert Options().key() == Options().key() != Options(images_scale=2.0).key()


def test_page_range_beyond_the_end(spark):
    docs = spark.createDataFrame([(1, 3), (2, 0), (3, None)], "doc_id long, page_count int")
    assert [r.page_no for r in formats.expand_pages(docs, Limits(page_range=(2, 9))).orderBy("page_no").collect()] == [2, 3]
    assert formats.expand_pages(docs, Limits(page_range=(4, 9))).count() == 0
