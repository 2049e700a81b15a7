"""Layout proposals from the cells alone, where there is no detection model: columns by white space, blocks by line gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.operators.layout import PAGE, usable
from leafmill.operators.reading import MARKER

#: In heights of a line: white space between columns, between lines of two blocks, and how much higher a heading is than its page's lines.
GUTTER, LEAD, HEADING = 1.0, 0.6, 1.15


def _islands(order: Window, starts: Column) -> Column:
    """A running number that grows by one at each row that starts something."""
    return F.sum(starts.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))


def proposals(cells: DataFrame) -> DataFrame:
    """``(page, id, label, l, t, r, b, conf)``: blocks of lines that follow each other in a column.

    Columns are what is left between vertical strips that no cell of the page touches. A block ends where the gap to the
    next line is over ``LEAD`` of its height, where heights differ by over ``HEADING``, and before list markers.
    """
    own = usable(cells).withColumn("high", F.col("b") - F.col("t"))
    across = Window.partitionBy(*PAGE).orderBy("l", "idx")
    reach = F.max("r").over(across.rowsBetween(Window.unboundedPreceding, -1))
    usual = F.percentile_approx("high", 0.5).over(Window.partitionBy(*PAGE))
    own = own.withColumn("usual", usual).withColumn("column", _islands(across, F.coalesce(F.col("l") - reach > GUTTER * F.col("high"), F.lit(True))))
    down = Window.partitionBy(*PAGE, "column").orderBy("t", "l", "idx")
    above, high = F.lag("b").over(down), F.lag("high").over(down)
    ratio = F.greatest(F.col("high"), high) / F.least(F.col("high"), high)
    starts = F.coalesce((F.col("t") - above > LEAD * F.col("high")) | (ratio > HEADING), F.lit(True)) | F.col("text").rlike(MARKER)
    own = own.withColumn("block", _islands(down, starts))
    blocks = own.groupBy(*PAGE, "column", "block").agg(*(F.min(c).alias(c) for c in "lt"), *(F.max(c).alias(c) for c in "rb"), F.min("high").alias("high"), F.first("usual").alias("usual"), F.min_by("text", F.struct("t", "l", "idx")).alias("first"))
    label = F.when(F.col("first").rlike(MARKER), "list_item").when(F.col("high") > HEADING * F.col("usual"), "section_header").otherwise("text")
    ident = F.row_number().over(Window.partitionBy(*PAGE).orderBy("column", "block")) - 1
    return blocks.select(*PAGE, ident.cast("int").alias("id"), label.alias("label"), *"ltrb", F.lit(1.0).alias("conf"))
