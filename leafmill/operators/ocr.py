"""OCR regions and the merging of OCR cells with programmatic ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmill.config import OcrOptions
from leafmill.functions.geometry import area, box, touches

PAGE = ("doc_id", "page_no")


def bitmap_rects(bitmaps: DataFrame, scale: float = 1.0) -> DataFrame:
    """Rectangles with an area, scaled."""
    own = bitmaps.filter(area(box()) > 0)
    return own.withColumns({c: F.col(c) * scale for c in "ltrb"}) if scale != 1.0 else own


#: Pixels that the 20 x 20 dilation reaches before and after.
BEFORE, AFTER = 10, 9


def pixels(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """``(page, rs)``: a page's rectangles as dilated, inclusive pixel ranges inside the page, sorted by top.

    A rectangle is rounded, cut to the page, grown by the dilation and cut again; those outside the page are gone.
    """
    own = rects.select(*PAGE, "rect_id", *"ltrb").join(pages.select(*PAGE, F.bround("width").alias("w"), F.bround("height").alias("h")), list(PAGE))
    drawn = {"x0": F.greatest(F.bround("l"), F.lit(0.0)), "y0": F.greatest(F.bround("t"), F.lit(0.0)), "x1": F.least(F.bround("r"), F.col("w") - 1), "y1": F.least(F.bround("b"), F.col("h") - 1)}
    own = own.withColumns(drawn).filter("x0 <= x1 and y0 <= y1")
    grown = {"x0": F.greatest(F.col("x0") - BEFORE, F.lit(0.0)), "y0": F.greatest(F.col("y0") - BEFORE, F.lit(0.0)), "x1": F.least(F.col("x1") + AFTER, F.col("w") - 1), "y1": F.least(F.col("y1") + AFTER, F.col("h") - 1)}
    own = own.withColumns(grown).withColumn("id", F.col("rect_id"))
    return own.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "x1", "y1", "id"))).alias("rs"))


def regions(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Connected regions of a page's dilated rectangles and their boxes: ``(page, region, l, t, r, b)``.

    Pixels join over their sides, not over corners. A page's rectangles are few; they are folded into
    components inside one row, without a loop of joins.
    """

    def near(a, b):
        dx = F.greatest(a["x0"], b["x0"]) - F.least(a["x1"], b["x1"])
        dy = F.greatest(a["y0"], b["y0"]) - F.least(a["y1"], b["y1"])
        return (dx <= 1) & (dy <= 1) & ((dx <= 0) | (dy <= 0))

    page = pixels(rects, pages)
    edges = F.flatten(F.transform("rs", lambda a: F.transform(F.filter("rs", lambda b: (b["id"] > a["id"]) & near(a, b)), lambda b: F.array(a["id"], b["id"]))))
    parts = merged_sets(F.transform("rs", lambda x: x["id"]), edges)
    out = page.withColumn("part", F.explode(parts)).withColumn("own", F.filter("rs", lambda x: F.array_contains("part", x["id"])))
    low = {c: F.array_min(F.transform("own", member(k))) for c, k in (("l", "x0"), ("t", "y0"))}
    high = {c: F.array_max(F.transform("own", member(k))) for c, k in (("r", "x1"), ("b", "y1"))}
    return out.select(*PAGE, F.array_min("part").alias("region"), *(v.alias(k) for k, v in (low | high).items()))


def member(name: str):
    """A lambda that takes a struct's field."""
    return lambda x: x[name]


def merged_sets(ids, edges):
    """Connected components as an array of id arrays: edges are folded in one after the other."""
    singles = F.transform(ids, lambda x: F.array(x))

    def fold(sets, e):
        hit = lambda s: F.array_contains(s, e[0]) | F.array_contains(s, e[1])
        return F.concat(F.filter(sets, lambda s: ~hit(s)), F.array(F.flatten(F.filter(sets, hit))))

    return F.aggregate(edges, singles, fold)


def coverage(rects: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with the part of their area that dilated rectangles cover; what several cover counts once.

    A sweep over the columns between the rectangles' edges: in each, the lengths covered are added up from the top.
    """
    page = pixels(rects, pages)
    edges = F.array_sort(F.array_distinct(F.flatten(F.transform("rs", lambda r: F.array(r["x0"], r["x1"] + 1)))))
    page = page.withColumn("xs", edges)

    def column(x, k):
        after = F.get("xs", k + 1)
        inside = F.filter("rs", lambda r: (r["x0"] <= x) & (r["x1"] + 1 >= after))
        none = F.struct(F.lit(-1.0).alias("end"), F.lit(0.0).alias("sum"))

        def add(done, r):
            more = F.greatest(F.lit(0.0), r["y1"] - F.greatest(done["end"], r["y0"] - 1))
            return F.struct(F.greatest(done["end"], r["y1"]).alias("end"), (done["sum"] + more).alias("sum"))

        return F.coalesce((after - x) * F.aggregate(inside, none, add)["sum"], F.lit(0.0))

    covered = page.select(*PAGE, F.aggregate(F.transform("xs", column), F.lit(0.0), lambda a, x: a + x).alias("covered"))
    share = F.coalesce("covered", F.lit(0.0)) / (F.col("width") * F.col("height"))
    return pages.join(covered, list(PAGE), "left").withColumn("coverage", share).drop("covered")


def decide(pages: DataFrame, options: OcrOptions = OcrOptions()) -> DataFrame:
    """Adds ``ocr_mode``: full page, regions, or none."""
    full = F.lit(options.force_full_page_ocr) | (F.col("coverage") > max(options.full_page_coverage, options.bitmap_area_threshold))
    return pages.withColumn("ocr_mode", F.when(full, "full_page").when(F.col("coverage") > options.bitmap_area_threshold, "regions").otherwise("none"))


def without_covered(ocr: DataFrame, programmatic: DataFrame) -> DataFrame:
    """OCR cells that touch no programmatic cell."""
    a, b = ocr.alias("a"), programmatic.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE]
    return a.join(b, [*on, touches(box("a."), box("b."))], "left_anti")


def combine(programmatic: DataFrame, ocr: DataFrame, forced: bool = False) -> DataFrame:
    """Programmatic cells, then OCR cells, numbered from zero; OCR cells only if forced."""
    both = ocr.withColumn("src", F.lit(1))
    if not forced:
        both = programmatic.withColumn("src", F.lit(0)).unionByName(both)
    order = Window.partitionBy(*PAGE).orderBy("src", "idx")
    return both.withColumn("idx", (F.row_number().over(order) - 1).cast("int")).drop("src")


def accepted(cells: DataFrame, options: OcrOptions = OcrOptions()) -> DataFrame:
    """OCR cells that reach their engine's threshold; engines without one keep all."""
    need = {"auto": options.text_score, "rapidocr": options.text_score, "easyocr": options.confidence_threshold}.get(options.engine)
    return cells if need is None else cells.filter(F.col("conf") >= need)


def in_regions(cells: DataFrame, decided: DataFrame, found: DataFrame) -> DataFrame:
    """OCR cells of pages that are read whole, and those that touch a region of pages that are read in parts."""
    whole = cells.join(decided.filter("ocr_mode = 'full_page'").select(*PAGE), list(PAGE), "left_semi")
    part = cells.join(decided.filter("ocr_mode = 'regions'").select(*PAGE), list(PAGE), "left_semi")
    a, b = part.alias("a"), found.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in PAGE]
    return whole.unionByName(a.join(b, [*on, touches(box("a."), box("b."))], "left_semi"))


def by_unit(cells: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Text lines, and the words and characters beside them, by ``granularity`` (missing or null: lines), which lines come without."""
    if "granularity" not in cells.columns:
        return cells, None
    unit = F.coalesce("granularity", F.lit("line"))
    return cells.filter(unit == "line").drop("granularity"), cells.filter(unit != "line")


def finer(programmatic: DataFrame | None, ocr: DataFrame | None, forced: bool = False) -> DataFrame | None:
    """Words and characters of both sources, None without either. Once OCR was forced, those of the file are no longer relied on."""
    parts = [t for t in (None if forced else programmatic, ocr) if t is not None]
    if len(parts) == 2:
        return parts[0].unionByName(parts[1], allowMissingColumns=True)
    return parts[0] if parts else None


def page_flags(cells: DataFrame, pages: DataFrame, forced: bool = False) -> DataFrame:
    """Per page: its cells that stay (if forced, those from OCR) by ``granularity`` (line, word, char; none: lines), and whether any do."""
    own = cells.withColumn("unit", F.col("granularity") if "granularity" in cells.columns else F.lit("line"))
    if forced:
        own = own.filter("from_ocr")
    counts = own.groupBy(*PAGE).agg(F.count("*").alias("n_cells"), *(F.count_if(F.col("unit") == k).alias(f"n_{k}s") for k in ("line", "word", "char")))
    out = pages.join(counts, list(PAGE), "left").select(*PAGE, *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_cells", "n_lines", "n_words", "n_chars")))
    return out.withColumns({"has_cells": F.col("n_cells") > 0} | {f"has_{k}s": F.col(f"n_{k}s") > 0 for k in ("line", "word", "char")})
