"""Text documents laid out as pages: the cells, detections and side tables that page operators read.

A page has forty lines of sixteen units, and one of three sizes. All numbers are integer formulas of document,
page and line, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTH, HEIGHT, LINES = 612.0, 792.0, 40
PAGE = ("doc_id", "page_no")


def cells(docs: DataFrame) -> DataFrame:
    """A text cell for each line."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("li", "text"))
    return lines.selectExpr(
        "doc_id", "cast(li div 40 + 1 as int) page_no", "cast(li % 40 as int) idx", "text", "72.0d l", "cast(72 + 16 * (li % 40) as double) t",
        "cast(72 + least(468, 5 * length(text)) as double) r", "cast(84 + 16 * (li % 40) as double) b", "li % 5 = 4 from_ocr",
        "case when li % 5 = 4 then cast(60 + ((doc_id + li) % 40) as double) / 100.0d else 1.0d end conf",
    )


def detections(cell: DataFrame) -> DataFrame:
    """Layout proposals: a block for every three lines, near copies, specials and half-line shifts."""
    base = cell.groupBy("doc_id", "page_no", F.expr("idx div 3").alias("k")).agg(F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))
    five = base.withColumn("v", F.explode(F.array(*map(F.lit, range(5)))))
    keep = """(v = 0 and (doc_id + k) % 6 <> 5) or (v = 1 and (doc_id + k) % 2 = 0) or (v = 2 and (doc_id + k) % 4 = 0)
        or (v = 3 and (doc_id + k) % 3 = 0) or (v = 4 and (doc_id + k) % 5 = 1)"""
    label = """case v when 2 then element_at(array('table','picture','form','key_value_region','document_index'), cast(1 + (doc_id + k div 4) % 5 as int))
        when 1 then element_at(array('text','code','list_item','text','footnote'), cast(1 + (doc_id * 5 + k) % 5 as int))
        else element_at(array('text','list_item','section_header','code','title','text','formula','caption','page_header','page_footer'),
            cast(1 + (doc_id * 7 + k * 3 + v) % 10 as int)) end label"""
    return five.filter(keep).selectExpr(
        "doc_id", "page_no", "cast(row_number() over (partition by doc_id, page_no order by k, v) - 1 as int) id", "cast(k as int) k", "v", label,
        "l - v l", "t - v + (case when v = 4 then 22 else 0 end) - (case when v = 2 then ((doc_id + k) div 4) % 2 * 20 else 0 end) t", "r + v r",
        "b + v + (case when v = 4 then 18 when v = 2 then (doc_id % 3) * 24 else 0 end) b",
        "cast(35 + (doc_id * 13 + k * 29 + v * 17) % 65 as double) / 100.0d conf",
    )


def corrupted(cell: DataFrame) -> DataFrame:
    """Cells with a fixed corruption by document and line, so that the text rules have work."""
    m = F.expr("(doc_id * 7 + idx) % 12")
    text = F.col("text")
    out = (
        F.when(m == 0, F.concat(text, F.lit("�"))).when(m == 1, F.concat(F.lit("GLYPH<0A1f> "), text)).when(m == 2, F.concat(text, F.lit(" /G12/G3")))
        .when(m == 3, F.concat(F.lit("/ab /cd "), text)).when(m == 4, F.concat(F.lit("a/ab.cd/ef.gh b/x.y/z.w c/i.j/k.l "), text))
        .when(m == 5, F.concat(F.lit("a/ab.cd/ef.gh b/x.y/z.w "), text)).when(m == 6, F.concat(text, F.lit("-"))).when(m == 7, F.concat(text, F.lit("\x02")))
        .when(m == 8, F.concat(F.lit("“"), text, F.lit("” ’x‘ • ⁄"))).when(m == 9, F.lit("   ")).otherwise(text)
    )
    return cell.withColumn("text", out)


def page_dim(cell: DataFrame) -> DataFrame:
    """Pages of three sizes; one in eleven fails to load."""
    pages = cell.select(*PAGE).distinct()
    size = "case (doc_id + page_no) % 3 when 0 then {0}d when 1 then {1}d else {2}d end"
    return pages.selectExpr("doc_id", "page_no", f"{size.format(612.0, 595.0, 842.0)} width", f"{size.format(792.0, 842.0, 1191.0)} height", "(doc_id * 3 + page_no) % 11 <> 0 backend_ok")


def bitmaps(pages: DataFrame) -> DataFrame:
    """Embedded bitmap rectangles; some documents have a full-page one, some none."""
    three = pages.withColumn("rect_id", F.explode(F.array(*map(F.lit, range(3)))))
    own = three.filter("case when doc_id % 13 = 0 then rect_id = 0 when doc_id % 13 = 1 then false else (doc_id + rect_id) % 3 <> 0 end")
    full = "doc_id % 13 = 0"
    return own.selectExpr(
        "doc_id", "page_no", "rect_id", f"cast(case when {full} then 0 else 40 + 180 * rect_id end as double) l", f"cast(case when {full} then 0 else 60 + (doc_id % 7) * 90 end as double) t",
        f"cast(case when {full} then 612 else least(612, 40 + 180 * rect_id + 60 + (doc_id % 5) * 70) end as double) r",
        f"cast(case when {full} then 792 else least(792, 60 + (doc_id % 7) * 90 + 40 + (doc_id % 4) * 120) end as double) b",
    )


def ocr_cells(cell: DataFrame) -> DataFrame:
    """OCR results: some over their own line, some in the empty margin."""
    return cell.filter("idx % 4 in (1, 3)").selectExpr(
        "doc_id", "page_no", "idx", "text", "l + (case when idx % 4 = 3 then 500 else 0 end) l", "t + (case when idx % 4 = 1 then 7 else 0 end) t",
        "r + (case when idx % 4 = 3 then 500 else 0 end) r", "b + (case when idx % 4 = 1 then 7 else 0 end) b", "true from_ocr", "cast(50 + (doc_id + idx) % 50 as double) / 100.0d conf",
    )


def admission(docs: DataFrame) -> DataFrame:
    """Documents as files with a made-up name, a size and a page count."""
    ext = "element_at(array('docx','pptx','html','png','pdf','adoc','md','csv','xlsx','txt','xml','tar.gz','json','wav','vtt','PDF'), cast(1 + doc_id % 16 as int))"
    return docs.selectExpr("doc_id", f"concat('doc', cast(doc_id as string), '.', {ext}) file", "n_chars filesize", "cast(ceil(size(split(text, '\\n', -1)) / 40.0) as int) page_count")


def pipe_tables(docs: DataFrame) -> DataFrame:
    """Cells of the tables that lines with `` | `` spell: ``(doc_id, row, col, text)``; other lines have none."""
    lines = docs.filter(F.instr("text", " | ") > 0).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("li", "line"))
    rows = lines.filter(F.instr("line", " | ") > 0)
    ranked = rows.selectExpr("doc_id", "line", "cast(row_number() over (partition by doc_id order by li) - 1 as int) row")
    return ranked.select("doc_id", "row", F.posexplode(F.split("line", r" \| ", -1)).alias("col", "text"))


def drawn_slots() -> list[tuple[int, int, str, float, float, float, float]]:
    """``(layout, slot, label, l, t, r, b)``: three page layouts of 13 blocks each, slots in the order in which they are to be read.

    0: a title, three columns, a heading over all of them, three columns. 1: headings over two columns, a sidebar beside all.
    2: four columns and a wide foot. The first blocks of neighbouring columns start at one height.
    """
    out: list[tuple[int, int, str, float, float, float, float]] = []

    def draw(layout: int, left: float, right: float, top: float, count: int, pitch: float, label: str = "text") -> None:
        for k in range(count):
            out.append((layout, sum(x[0] == layout for x in out), label, *map(float, (left, top + pitch * k, right, top + pitch * k + pitch - 12))))

    thirds = [(40.0, 205.0), (215.0, 390.0), (400.0, 570.0)]
    for top, head, counts in ((40.0, "title", (2, 2, 2)), (360.0, "section_header", (2, 2, 1))):
        draw(0, 40, 570, top, 1, 40, head)
        for (left, right), n, pitch in zip(thirds, counts, (90, 90, 120), strict=True):
            draw(0, left, right, top + 40, n, pitch)
    for top, counts in ((40.0, (3, 3)), (400.0, (2, 1))):
        draw(1, 40, 390, top, 1, 40, "section_header")
        for (left, right), n, pitch in zip(thirds, counts, (80, 100), strict=False):
            draw(1, left, right, top + 40, n, pitch)
    draw(1, *thirds[2], 40, 2, 300)
    for left, n, pitch in ((40.0, 4, 100), (180.0, 4, 110), (320.0, 3, 150)):
        draw(2, left, left + 125, 40, n, pitch)
    draw(2, 460, 570, 40, 1, 440)
    draw(2, 40, 570, 600, 1, 60)
    return out


def drawn_columns(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Elements and pages of documents of which every line is a block, 13 a page; ids are no guide to the order."""
    spark = docs.sparkSession
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("li", "line"))
    slot = F.col("li") % 13
    own = lines.select("doc_id", (F.expr("li div 13") + 1).alias("page_no"), slot.alias("slot"), ((slot * 7 + 3) % 13).alias("id"), F.length("line").alias("n_chars"))
    own = own.withColumn("layout", (F.col("page_no") % 3).cast("int"))
    places = spark.createDataFrame(drawn_slots(), "layout int, slot int, label string, l double, t double, r double, b double")
    elements = own.join(F.broadcast(places), ["layout", "slot"]).drop("layout", "slot")
    return elements, own.select("doc_id", "page_no").distinct().select("doc_id", "page_no", F.lit(WIDTH).alias("width"), F.lit(HEIGHT).alias("height"))
