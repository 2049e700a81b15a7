"""HTML pages as elements, by regular expressions over the markup (no UDF)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Block tags and the labels of their text.
LABELS = {"title": "title", "h1": "section_header", "p": "text", "li": "list_item", "footer": "page_footer", "nav": "page_header"}
#: Character references that are resolved.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&"))
DROPPED = r"(?is)<(script|style)[^>]*>.*?</(script|style)>|<!--.*?-->"
#: A block runs from its opening tag to the next opening or closing of any block.
BLOCK = r"(?is)<(title|h1|p|li|footer|nav)(?:\s[^>]*)?>(.*?)(?=</?(?:title|h1|p|li|footer|nav|ul|article|div|body|html|head)\b|$)"


def resolved(text: Column) -> Column:
    for ref, char in ENTITIES:
        text = F.replace(text, F.lit(ref), F.lit(char))
    return text


def visible(markup: Column) -> Column:
    """Text without tags, white space squeezed."""
    return F.trim(F.regexp_replace(resolved(F.regexp_replace(markup, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def elements(pages: DataFrame) -> DataFrame:
    """``(page_id, ord, tag, label, text)`` of each block with text."""
    clean = F.regexp_replace(F.col("html"), DROPPED, " ")
    pairs = F.arrays_zip(F.regexp_extract_all(clean, F.lit(BLOCK), F.lit(1)).alias("tag"), F.regexp_extract_all(clean, F.lit(BLOCK), F.lit(2)).alias("body"))
    rows = pages.select("page_id", F.posexplode(pairs).alias("ord", "x"))
    tag = F.lower("x.tag")
    label = F.lit(None).cast("string")
    for name, kind in LABELS.items():
        label = F.when(tag == name, kind).otherwise(label)
    return rows.select("page_id", "ord", tag.alias("tag"), label.alias("label"), visible(F.col("x.body")).alias("text")).filter("text <> ''")


def page_text(pages: DataFrame) -> DataFrame:
    """``(page_id, text)``: all blocks of a page, a line each."""
    own = elements(pages).groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("ord", "text"))).alias("xs"))
    made = own.select("page_id", F.array_join(F.transform("xs", lambda x: x["text"]), "\n").alias("text"))
    return pages.select("page_id").join(made, "page_id", "left").withColumn("text", F.coalesce("text", F.lit("")))
