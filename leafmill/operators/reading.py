"""Reading order and the items of the output document, by windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.functions.text import clean_lines

PAGE = ("doc_id", "page_no")
#: What a bullet or number in front of a list item looks like.
MARKER = r"^\s*([-*•·]|\d+[.)])\s+"
CAPTIONED = ("table", "figure")


def in_document():
    """A document's elements in reading order."""
    return Window.partitionBy("doc_id").orderBy("seq")


def reading_order(elements: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``width``, ``height`` of the page, and ``seq``: page headers, then body by column, top and left, then page footers.

    A page has two columns if some body box lies left and some right of its centre without touching it.
    """
    elements = elements.join(pages.select(*PAGE, "width", "height"), list(PAGE), "left")
    mid = F.col("width") / 2
    body = ~F.col("label").isin("page_header", "page_footer")
    page = Window.partitionBy(*PAGE)
    left = F.max(F.when(body & (F.col("r") <= mid), 1).otherwise(0)).over(page)
    right = F.max(F.when(body & (F.col("l") >= mid), 1).otherwise(0)).over(page)
    column = F.when(body & (left == 1) & (right == 1) & ((F.col("l") + F.col("r")) / 2 > mid), 1).otherwise(0)
    zone = F.when(F.col("label") == "page_header", 0).when(F.col("label") == "page_footer", 2).otherwise(1)
    out = elements.withColumn("zone", zone).withColumn("column", column)
    order = Window.partitionBy("doc_id").orderBy("page_no", "zone", "column", "t", "l", "id")
    return out.withColumn("seq", (F.row_number().over(order) - 1).cast("int"))


def neighbours(ordered: DataFrame) -> DataFrame:
    """Adds kind, label, page and id of the elements before and after in the document."""
    cols = ("kind", "label", "page_no", "id")
    return ordered.withColumns({f"prev_{c}": F.lag(c).over(in_document()) for c in cols} | {f"next_{c}": F.lead(c).over(in_document()) for c in cols})


def takes_caption(kind: Column, label: Column) -> Column:
    return kind.isin(*CAPTIONED) | (label == "code")


def caption_target() -> Column:
    """The id of the table, figure or code next to an element with its neighbours on its page, that after it first."""
    beside = {side: takes_caption(F.col(f"{side}_kind"), F.col(f"{side}_label")) & (F.col(f"{side}_page_no") == F.col("page_no")) for side in ("next", "prev")}
    return F.when(beside["next"], F.col("next_id")).when(beside["prev"], F.col("prev_id"))


def caption_links(ordered: DataFrame) -> DataFrame:
    """``(page, id, target_id)``: each caption with the table, figure or code next to it on its page, that after it first."""
    return neighbours(ordered).filter("label = 'caption'").withColumn("target_id", caption_target()).filter("target_id is not null").select(*PAGE, "id", "target_id")


def footnote_links(ordered: DataFrame) -> DataFrame:
    """Each footnote of a run with the table, figure or code right before the run, on the same page."""
    is_note = F.col("label") == "footnote"
    last = Window.partitionBy("doc_id", "page_no").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(~is_note, F.struct("kind", "label", "id")), ignorenulls=True).over(last)
    notes = ordered.withColumn("anchor", anchor).filter(is_note)
    fits = takes_caption(F.col("anchor.kind"), F.col("anchor.label"))
    return notes.filter(fits).select(*PAGE, "id", F.col("anchor.id").alias("target_id"))


def open_end(text: Column) -> Column:
    """Whether a text has no end punctuation, so that it may go on elsewhere."""
    return ~text.rlike(r"[.!?:;]\s*$") & (text != "")


def goes_on() -> Column:
    """Whether an element goes on from the one before: of columns label, page_no, column, open_end and low (begins in lower case)."""
    before = lambda c: F.lag(c).over(in_document())
    same = (F.col("label") == "text") & (before("label") == "text")
    moved = (before("page_no") < F.col("page_no")) | (before("column") < F.col("column"))
    return F.coalesce(same & moved & before("open_end") & F.col("low"), F.lit(False))


def with_ends(ordered: DataFrame) -> DataFrame:
    return ordered.withColumns({"open_end": open_end(F.col("text")), "low": F.col("text").rlike(r"^\p{Ll}")})


def merge_heads(ordered: DataFrame) -> DataFrame:
    """Adds ``head``: the seq of the text that an element goes on from; its own otherwise.

    A text goes on in the next element if that is a text on the next page (or column), the first lacks
    end punctuation and the second starts in lower case.
    """
    own = with_ends(ordered).withColumn("goes_on", goes_on())
    heads = F.max(F.when(~F.col("goes_on"), F.col("seq"))).over(in_document().rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("head", heads).drop("open_end", "low", "goes_on")


def merged_texts(ordered: DataFrame) -> DataFrame:
    """One row for each head: its whole text, and where each part lies in it and on its page (origin bottom left)."""
    return joined_parts(merge_heads(ordered))


def joined_parts(h: DataFrame) -> DataFrame:
    """The texts of each ``head`` as one."""
    run = Window.partitionBy("doc_id", "head").orderBy("seq")
    start = F.coalesce(F.sum(F.length("text") + 1).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    part = F.struct("seq", "text", "page_no", start.cast("int").alias("start"), "l", (F.col("height") - F.col("t")).alias("t"), "r", (F.col("height") - F.col("b")).alias("b"))
    parts = h.withColumn("part", part).groupBy("doc_id", "head").agg(F.sort_array(F.collect_list("part")).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), " ")
    spans = F.transform("parts", lambda p: F.struct(p["page_no"].alias("page_no"), p["start"].alias("start"), (p["start"] + F.length(p["text"])).alias("end"), *(p[c].alias(c) for c in "ltrb")))
    return parts.select("doc_id", F.col("head").alias("seq"), text.alias("text"), F.size("parts").alias("n_parts"), spans.alias("prov"))


def list_groups(ordered: DataFrame) -> DataFrame:
    """List items with ``group_no``: a text other than an item or code closes a group; tables and figures do not."""
    closes = (F.col("kind") == "text") & ~F.col("label").isin("list_item", "code")
    run = F.sum(F.when(closes, 1).otherwise(0)).over(in_document().rowsBetween(Window.unboundedPreceding, 0))
    items = ordered.withColumn("run", run).filter("label = 'list_item'")
    return items.withColumn("group_no", (F.dense_rank().over(Window.partitionBy("doc_id").orderBy("run")) - 1).cast("int")).drop("run")


def marker(text: Column) -> tuple[Column, Column]:
    """A list item's marker, and its text without it."""
    return F.regexp_extract(text, MARKER, 1), F.regexp_replace(text, MARKER, "")


def layer(label: Column) -> Column:
    return F.when(label.isin("page_header", "page_footer"), "furniture").otherwise("body")


def ref_of(page_no: Column, ident: Column) -> Column:
    return F.concat(F.lit("#/"), page_no.cast("string"), F.lit("/"), ident.cast("string"))


def links(ordered: DataFrame) -> DataFrame:
    """``(doc_id, seq, goes_on, head, joins, parent_ref, caption_refs, footnote_refs)`` of every element, by windows over documents.

    What the texts have to say is two flags, so no text is sorted here. ``joins``: whether an element is part of a text of several.
    """
    own = neighbours(with_ends(ordered).select("doc_id", "seq", "page_no", "id", "kind", "label", "column", "open_end", "low"))
    is_note = F.col("label") == "footnote"
    so_far = in_document().rowsBetween(Window.unboundedPreceding, 0)
    before = in_document().rowsBetween(Window.unboundedPreceding, -1)
    anchor = F.last(F.when(~is_note, F.struct("kind", "label", "page_no", "id")), ignorenulls=True).over(before)
    own = own.withColumns({"goes_on": goes_on(), "anchor": anchor})
    noted = is_note & (F.col("anchor.page_no") == F.col("page_no")) & takes_caption(F.col("anchor.kind"), F.col("anchor.label"))
    own = own.withColumn("target_id", F.coalesce(F.when(F.col("label") == "caption", caption_target()), F.when(noted, F.col("anchor.id"))))
    main = F.isnull("target_id") & ~F.col("goes_on")
    closes = main & (F.col("kind") == "text") & ~F.col("label").isin("list_item", "code")
    own = own.withColumns({"ref": ref_of(F.col("page_no"), F.col("id")), "item": main & (F.col("label") == "list_item")})
    beside = {f"{side}_{c}": f(c).over(in_document()) for side, f in (("prev", F.lag), ("next", F.lead)) for c in ("target_id", "ref")}
    own = own.withColumns(
        {
            "head": F.max(F.when(~F.col("goes_on"), F.col("seq"))).over(so_far), "joins": F.col("goes_on") | F.coalesce(F.lead("goes_on").over(in_document()), F.lit(False)),
            "run": F.sum(F.when(closes, 1).otherwise(0)).over(so_far),
        } | beside
    )
    last_run = F.last(F.when(F.col("item"), F.col("run")), ignorenulls=True).over(before)
    own = own.withColumn("opens", F.col("item") & F.coalesce(last_run != F.col("run"), F.lit(True)))
    own = own.withColumn("group_no", F.sum(F.col("opens").cast("int")).over(so_far) - 1)
    mine = lambda side: (F.col(f"{side}_label") == "caption") & (F.col(f"{side}_page_no") == F.col("page_no")) & (F.col(f"{side}_target_id") == F.col("id"))
    captions = F.array_compact(F.array(*(F.when(mine(side), F.col(f"{side}_ref")) for side in ("prev", "next"))))
    # a footnote lies in the group of what it belongs to, all else in one of its own
    group = Window.partitionBy("doc_id", "page_no", "group")
    own = own.withColumn("group", F.when(is_note, F.coalesce("target_id", "id")).otherwise(F.col("id")))
    notes = F.sort_array(F.collect_list(F.when(is_note & F.col("target_id").isNotNull(), F.struct("seq", "ref"))).over(group))
    parent = F.when(F.col("target_id").isNotNull(), ref_of(F.col("page_no"), F.col("target_id"))).when(F.col("item"), F.concat(F.lit("#/groups/"), F.col("group_no").cast("string")))
    footnotes = F.when(is_note, F.array().cast("array<string>")).otherwise(F.transform("notes", lambda p: p["ref"]))
    own = own.withColumn("notes", notes)
    return own.select("doc_id", "seq", "goes_on", "head", "joins", parent.alias("parent_ref"), captions.alias("caption_refs"), footnotes.alias("footnote_refs"))


def items(ordered: DataFrame) -> DataFrame:
    """Document items: ``(doc_id, seq, item_ref, parent_ref, type, content_layer, text, orig, marker, prov, caption_refs, footnote_refs)``.

    Captions and footnotes are children of what they belong to, which lists them; a text that goes on elsewhere is one
    item with several provenances; list items are children of their group. Only texts have text: a
    formula's is its ``orig``, a list item's comes without its marker. ordered is read several times: store it first.
    Texts are moved once, to their links; only parts of texts that go on are moved again.
    """
    found = links(ordered)
    may_join = with_ends(ordered).filter("label = 'text' and (open_end or low)")
    parts = may_join.join(found.filter("joins").select("doc_id", "seq", "head"), ["doc_id", "seq"])
    several = joined_parts(parts).select("doc_id", "seq", F.col("text").alias("joined_text"), F.col("prov").alias("joined_prov"))
    rows = ordered.join(found.filter("not goes_on").drop("goes_on", "head", "joins"), ["doc_id", "seq"]).join(several, ["doc_id", "seq"], "left")
    alone = F.struct("page_no", F.lit(0).alias("start"), F.length("text").alias("end"), "l", (F.col("height") - F.col("t")).alias("t"), "r", (F.col("height") - F.col("b")).alias("b"))
    rows = rows.withColumns({"whole": F.coalesce("joined_text", "text"), "prov": F.coalesce("joined_prov", F.array(alone)), "item_ref": ref_of(F.col("page_no"), F.col("id"))}).drop("text")
    kind = F.when(F.col("label") == "section_header", "heading").when(F.col("kind") == "text", F.col("label")).otherwise(F.col("kind"))
    is_text = F.col("kind") == "text"
    mark, rest = marker(F.col("whole"))
    listed = F.col("label") == "list_item"
    text = F.when(~is_text | (F.col("label") == "formula"), "").when(listed, rest).otherwise(F.col("whole"))
    blank = F.transform("prov", lambda p: F.struct(p["page_no"].alias("page_no"), F.lit(0).alias("start"), F.lit(0).alias("end"), *(p[c].alias(c) for c in "ltrb")))
    return rows.select(
        "doc_id", "seq", "item_ref", "parent_ref", kind.alias("type"), layer(F.col("label")).alias("content_layer"), text.alias("text"),
        F.when(is_text, F.col("whole")).otherwise("").alias("orig"), F.when(listed & (mark != ""), mark).alias("marker"), F.when(is_text, F.col("prov")).otherwise(blank).alias("prov"),
        "caption_refs", "footnote_refs",
    )


def child_items(kids: DataFrame, specials: DataFrame, cells: DataFrame) -> DataFrame:
    """``(doc_id, page_no, item_ref, parent_ref, child_no, type, text)``: what lies in figures, containers and tables
    without a structure (specials: their ids, kind and num_rows), in cell order."""
    open_ = specials.filter("kind in ('figure', 'container') or kind = 'table' and coalesce(num_rows, 0) = 0").select(*PAGE, F.col("id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    own = kids.join(open_, [*PAGE, "parent_id"]).select(*PAGE, "parent_id", "parent_kind", "child_id", "child_label", "t", "l", F.explode_outer("cells").alias("cell"))
    lines = own.withColumn("idx", F.col("cell.idx")).join(cells.select(*PAGE, "idx", F.col("text").alias("line")), [*PAGE, "idx"], "left")
    made = lines.groupBy(*PAGE, "parent_id", "parent_kind", "child_id", "child_label", "t", "l").agg(F.sort_array(F.collect_list(F.when(F.col("line").isNotNull(), F.struct("idx", "line")))).alias("xs"))
    first = F.coalesce(F.get("xs", F.lit(0))["idx"].cast("double"), F.lit(float("inf")))
    nth = F.row_number().over(Window.partitionBy(*PAGE, "parent_id").orderBy(first, "t", "l", "child_id"))
    text = F.array_join(clean_lines(F.transform("xs", lambda x: x["line"])), " ")
    parent = F.concat(ref_of(F.col("page_no"), F.col("parent_id")), F.when(F.col("parent_kind") == "table", "/cell").otherwise(""))
    kind = F.when(F.col("child_label") == "list_item", "list_item").when(F.col("child_label") == "section_header", "heading").otherwise(F.col("child_label"))
    return made.select("doc_id", "page_no", ref_of(F.col("page_no"), F.col("child_id")).alias("item_ref"), parent.alias("parent_ref"), nth.cast("int").alias("child_no"), kind.alias("type"), text.alias("text"))


def container_label(label: Column) -> Column:
    return F.when(label == "form", "form_area").when(label == "key_value_region", "key_value_area")


def all_pages(expected: DataFrame, done: DataFrame) -> DataFrame:
    """Every expected page: with its size if it was processed, zero by zero if not."""
    sizes = done.select(*PAGE, "width", "height")
    out = expected.select(*PAGE).join(sizes, list(PAGE), "left")
    return out.withColumn("missing", F.col("width").isNull()).withColumn("width", F.coalesce("width", F.lit(0.0))).withColumn("height", F.coalesce("height", F.lit(0.0)))
