"""Table structure from where texts stand: row bands, columns by projection profiles, spanning cells.

All steps are windows and joins by table; nothing is assumed about lines or separators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.layout import PAGE
from leafmill.storage import stored

TABLE = (*PAGE, "id")
#: In heights of a text: how far rows may overlap, and the least width of a gap between columns.
OVERLAP, GUTTER = 0.3, 0.5


def _running(order: Window, starts: Column) -> Column:
    return F.sum(F.coalesce(starts, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1


def cells_of(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """``(table, idx, text, l, t, r, b)`` of clusters whose ``cells`` list them; blank texts are none."""
    own = tables.select(*TABLE, F.explode("cells").alias("c")).select(*TABLE, F.col("c.idx").alias("idx"))
    return own.join(cells.select(*PAGE, "idx", F.trim("text").alias("text"), *"ltrb"), [*PAGE, "idx"]).filter("text <> '' and r > l and b > t").select(*TABLE, "idx", "text", *"ltrb")


def rows_of(texts: DataFrame) -> DataFrame:
    """Adds ``row``: a text that begins below all before it, but for ``OVERLAP`` of its height, begins a row."""
    down = Window.partitionBy(*TABLE).orderBy("t", "l", "idx")
    reach = F.max("b").over(down.rowsBetween(Window.unboundedPreceding, -1))
    return texts.withColumn("row", _running(down, F.col("t") > reach - OVERLAP * (F.col("b") - F.col("t"))))


def columns_of(texts: DataFrame) -> DataFrame:
    """``(table, col, x0, x1)``: what lies between gaps of the projection of all rows onto the x axis.

    A gap is at least ``GUTTER`` heights wide, and no row crosses it; where there are three rows or more, one in five may, and one
    always, so that a spanning heading does not close it.
    """
    size = texts.groupBy(*TABLE).agg((F.max("row") + 1).alias("rows"), F.percentile_approx(F.col("b") - F.col("t"), 0.5).alias("high"))
    # texts of a row that touch or overlap are one stretch, so a row counts once wherever it covers
    along = Window.partitionBy(*TABLE, "row").orderBy("l", "r")
    reach = F.max("r").over(along.rowsBetween(Window.unboundedPreceding, -1))
    stretch = texts.withColumn("stretch", _running(along, F.col("l") > reach)).groupBy(*TABLE, "row", "stretch").agg(F.min("l").alias("l"), F.max("r").alias("r"))
    edges = stretch.select(*TABLE, F.explode(F.array(F.struct(F.col("l").alias("x"), F.lit(1).alias("by")), F.struct(F.col("r").alias("x"), F.lit(-1).alias("by")))).alias("e"))
    edges = edges.groupBy(*TABLE, F.col("e.x").alias("x")).agg(F.sum("e.by").alias("by"))
    across = Window.partitionBy(*TABLE).orderBy("x")
    strips = edges.withColumn("covered", F.sum("by").over(across.rowsBetween(Window.unboundedPreceding, 0))).withColumn("end", F.lead("x").over(across)).filter("end is not null")
    may = F.when(F.col("rows") >= 3, F.greatest(F.lit(1), F.floor(F.col("rows") / 5))).otherwise(0)
    strips = strips.join(size, list(TABLE)).withColumn("open", F.col("covered") <= may)
    # strips of one kind in a row are one; open ones that are too narrow are no gap
    runs = strips.withColumn("run", _running(across, F.col("open") != F.lag("open").over(across)))
    runs = runs.groupBy(*TABLE, "run", "open", "high").agg(F.min("x").alias("x0"), F.max("end").alias("x1"))
    runs = runs.withColumn("gap", F.col("open") & (F.col("x1") - F.col("x0") >= GUTTER * F.col("high")))
    by_run = Window.partitionBy(*TABLE).orderBy("run")
    solid = runs.filter("not gap").withColumn("col", _running(by_run, F.col("x0") != F.lag("x1").over(by_run)))
    found = solid.groupBy(*TABLE, "col").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    # a table whose every strip is open (one text, or texts that never stand below each other) is one column for each stretch
    rest = runs.join(found.select(*TABLE).distinct(), list(TABLE), "left_anti").select(*TABLE).distinct()
    alone = stretch.join(rest, list(TABLE), "left_semi")
    first = Window.partitionBy(*TABLE).orderBy("l", "r")
    ahead = F.max("r").over(first.rowsBetween(Window.unboundedPreceding, -1))
    alone = alone.withColumn("col", _running(first, F.col("l") >= ahead)).groupBy(*TABLE, "col").agg(F.min("l").alias("x0"), F.max("r").alias("x1"))
    return found.unionByName(alone)


def grid(tables: DataFrame, cells: DataFrame) -> DataFrame:
    """``(table, row, col, col_span, text)``: cells of the grid, texts of one place joined in reading order.

    A text spans the columns that it overlaps; one that overlaps none belongs to the next on its right, or to the last. Texts and
    columns are read several times, so they are written to the shared folder once.
    """
    texts = stored(rows_of(cells_of(tables, cells)), "table-texts")
    columns = stored(columns_of(texts), "table-columns")
    last = columns.groupBy(*TABLE).agg(F.max("col").alias("last"))
    t, c = texts.alias("t"), columns.alias("c")
    on = [F.col(f"t.{k}") == F.col(f"c.{k}") for k in TABLE]
    over = t.join(c, [*on, F.col("t.r") > F.col("c.x0")], "left")
    inside = F.col("c.x1") > F.col("t.l")
    place = over.groupBy(*(F.col(f"t.{k}").alias(k) for k in TABLE), "t.idx").agg(
        F.min(F.when(inside, F.col("c.col"))).alias("first"), F.max(F.when(inside, F.col("c.col"))).alias("until"), F.coalesce(F.max(F.when(~inside, F.col("c.col"))) + 1, F.lit(0)).alias("next")
    )
    placed = texts.join(place, [*TABLE, "idx"]).join(last, list(TABLE))
    col = F.coalesce("first", F.least("next", "last"))
    placed = placed.withColumn("col", col).withColumn("span", F.coalesce(F.col("until") - F.col("first") + 1, F.lit(1)))
    joined = placed.groupBy(*TABLE, "row", "col").agg(F.max("span").alias("col_span"), F.sort_array(F.collect_list(F.struct("t", "l", "idx", "text"))).alias("parts"))
    return joined.select(*TABLE, F.col("row").cast("int"), F.col("col").cast("int"), F.col("col_span").cast("int"), F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"))


def predicted(found: DataFrame) -> DataFrame:
    """``(page, cluster_id, num_rows, num_cols, score)`` of a grid; score is the part of it that its cells fill."""
    sized = found.groupBy(*TABLE).agg((F.max("row") + 1).cast("long").alias("num_rows"), F.max(F.col("col") + F.col("col_span")).cast("long").alias("num_cols"), F.sum("col_span").alias("filled"))
    return sized.select(*PAGE, F.col("id").alias("cluster_id"), "num_rows", "num_cols", (F.col("filled") / (F.col("num_rows") * F.col("num_cols"))).alias("score"))


def stage(tables: DataFrame, cells: DataFrame, options: object) -> DataFrame:
    """The table stage of ``GridOptions``."""
    return predicted(grid(tables, cells))
