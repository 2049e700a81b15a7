"""Page assembly: clusters become typed elements with text, tables and figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_lines, joined

PAGE = ("doc_id", "page_no")
#: Labels by the kind of element that they become; others are dropped.
KINDS = {
    "text": ("text", "footnote", "caption", "checkbox_unselected", "checkbox_selected", "section_header", "page_header", "page_footer", "code", "list_item", "formula"),
    "table": ("table", "document_index"),
    "figure": ("picture",),
    "container": ("form", "key_value_region"),
}
HEADERS = ("page_header", "page_footer")


def kind_of(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, labels in KINDS.items():
        out = F.when(label.isin(*labels), kind).otherwise(out)
    return out


def routed(clusters: DataFrame) -> DataFrame:
    """Adds ``kind`` and ``is_header``; clusters of other labels are dropped."""
    own = clusters.withColumn("kind", kind_of(F.col("label"))).filter("kind is not null")
    return own.withColumn("is_header", F.col("label").isin(*HEADERS))


def line_texts(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """``(page, id, text)``: the cleaned lines of a cluster's cells, joined with hyphenation mended; clusters without lines have no row."""
    own = clusters.select(*PAGE, "id", F.explode("cells").alias("cell")).select(*PAGE, "id", F.col("cell.idx").alias("idx"))
    lines = own.join(cells.select(*PAGE, "idx", "text"), [*PAGE, "idx"]).groupBy(*PAGE, "id").agg(F.sort_array(F.collect_list(F.struct("idx", "text"))).alias("lines"))
    lines = lines.withColumn("lines", clean_lines(F.transform("lines", lambda x: x["text"])))
    return lines.select(*PAGE, "id", joined(F.col("lines")).alias("text"))


def with_texts(elements: DataFrame, texts: DataFrame) -> DataFrame:
    """Adds ``text``, empty where there is none. Texts come last, so that what orders the elements does not move them."""
    return elements.join(texts, [*PAGE, "id"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def texts(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """Adds ``text``: the cleaned lines of a cluster's cells, joined with hyphenation mended."""
    return with_texts(clusters, line_texts(clusters, cells))


def with_tables(elements: DataFrame, predictions: DataFrame) -> DataFrame:
    """Adds num_rows and num_cols: of the predicted table, zero for tables without one, null for the rest."""
    out = elements.join(predictions.select(*PAGE, F.col("cluster_id").alias("id"), F.col("num_rows").alias("pr"), F.col("num_cols").alias("pc")), [*PAGE, "id"], "left")
    table = F.col("kind") == "table"
    return out.withColumn("num_rows", F.when(table, F.coalesce("pr", F.lit(0)))).withColumn("num_cols", F.when(table, F.coalesce("pc", F.lit(0)))).drop("pr", "pc")


def with_figures(elements: DataFrame, predictions: DataFrame) -> DataFrame:
    """Adds figure_class: as predicted, ``unclassified`` without a prediction, null for other kinds."""
    out = elements.join(predictions.select(*PAGE, F.col("cluster_id").alias("id"), F.col("figure_class").alias("fc")), [*PAGE, "id"], "left")
    return out.withColumn("figure_class", F.when(F.col("kind") == "figure", F.coalesce("fc", F.lit("unclassified")))).drop("fc")


def in_document_order(elements: DataFrame) -> DataFrame:
    """Adds ``seq`` from zero over a document's pages."""
    order = Window.partitionBy("doc_id").orderBy("page_no", "pos", "id")
    return elements.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))
