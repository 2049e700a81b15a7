"""Layout clean-up: cell assignment, overlap resolution, containment.

Tables are keyed by (doc_id, page_no). Overlapping clusters are found by a spatial join over tiles of a page, and only what
overlaps is grouped and settled together, as an array of its group; all other clusters pass by as rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmill.config import LayoutOptions
from leafmill.functions.geometry import area, box, fields, over_self, overlaps
from leafmill.functions.text import strip
from leafmill.operators.graph import connected_components
from leafmill.operators.ocr import member, merged_sets
from leafmill.storage import stored

PAGE = ("doc_id", "page_no")
#: Labels that need a confidence of 0.45 only; all others need 0.5.
LOW_GATE = ("section_header", "title", "code", "checkbox_selected", "checkbox_unselected", "form", "key_value_region", "document_index")
WRAPPERS = ("form", "key_value_region", "table", "document_index")
SPECIAL = (*WRAPPERS, "picture")
#: By class, the area ratio up to which and the confidence deficit from which a box yields.
PREFER = {"regular": (1.3, 0.05), "picture": (2.0, 0.3), "wrapper": (2.0, 0.2)}
CELL_OVERLAP, CONTAINED, FULL_PAGE = 0.2, 0.8, 0.90
#: How far a wrapper lies in a table, and its lead in confidence, for it to go.
TWIN, TWIN_CONFIDENCE = 0.9, 0.1


def ingest(raw: DataFrame) -> DataFrame:
    """Normalised labels: lower case, spaces and hyphens as underscores."""
    return raw.withColumn("label", F.translate(F.lower("label"), " -", "__"))


def gated(dets: DataFrame) -> DataFrame:
    need = F.when(F.col("label").isin(*LOW_GATE), 0.45).otherwise(0.5)
    return dets.filter(F.col("conf") >= need)


def remapped(dets: DataFrame) -> DataFrame:
    return dets.withColumn("label", F.when(F.col("label") == "title", "section_header").otherwise(F.col("label")))


def is_special() -> Column:
    return F.col("label").isin(*SPECIAL)


def box_class() -> Column:
    return F.when(F.col("label") == "picture", "picture").when(F.col("label").isin(*WRAPPERS), "wrapper").otherwise("regular")


def usable(cells: DataFrame) -> DataFrame:
    """Cells that are neither blank nor empty."""
    return cells.filter((strip(F.col("text")) != "") & (area(box()) > 0))


def on_page(a: str, b: str) -> list[Column]:
    return [F.col(f"{a}.{k}") == F.col(f"{b}.{k}") for k in PAGE]


def assign_cells(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """``(page, idx, id)``: each usable cell with the cluster that covers most of it, over a fifth; ties go to the first."""
    share = over_self(box("c."), box("k."))
    pairs = usable(cells).alias("c").join(clusters.alias("k"), [*on_page("c", "k"), share > CELL_OVERLAP])
    best = Window.partitionBy("c.doc_id", "c.page_no", "c.idx").orderBy(share.desc(), F.col("k.id"))
    ranked = pairs.select("c.doc_id", "c.page_no", "c.idx", "k.id", F.row_number().over(best).alias("rank"))
    return ranked.filter("rank = 1").drop("rank")


def placed_cells(clusters: DataFrame, cells: DataFrame) -> DataFrame:
    """``(page, idx, l, t, r, b, conf, id)``: every usable cell with its cluster as ``assign_cells`` gives it, or null."""
    share = over_self(box("c."), box("k."))
    pairs = usable(cells).alias("c").join(clusters.alias("k"), [*on_page("c", "k"), share > CELL_OVERLAP], "left")
    best = Window.partitionBy("c.doc_id", "c.page_no", "c.idx").orderBy(share.desc_nulls_last(), F.col("k.id"))
    own = (F.col(f"c.{x}") for x in (*PAGE, "idx", *"ltrb", "conf"))
    return pairs.select(*own, "k.id", F.row_number().over(best).alias("rank")).filter("rank = 1").drop("rank")


def orphans(places: DataFrame, dets: DataFrame) -> DataFrame:
    """A text cluster for each usable cell without one, with ids above all of the page's detections."""
    top = dets.groupBy(*PAGE).agg(F.max("id").alias("top"))
    order = Window.partitionBy(*PAGE).orderBy("idx")
    out = places.filter("id is null").join(top, list(PAGE), "left")
    ident = (F.coalesce("top", F.lit(0)) + F.row_number().over(order)).cast("int")
    return out.select(*PAGE, ident.alias("id"), F.lit("text").alias("label"), *"ltrb", "conf", F.col("idx"))


def with_cells(clusters: DataFrame, cells: DataFrame, dets: DataFrame, options: LayoutOptions = LayoutOptions()) -> DataFrame:
    """Regular clusters with their cells' boxes, empty ones dropped, orphans added: what refining starts from.

    Where the cells lie is read twice from here on, so it is written to the shared folder once.
    """
    places = stored(placed_cells(clusters, cells), "placed-cells")
    own = places.filter("id is not null").groupBy(*PAGE, "id").agg(F.sort_array(F.collect_list(F.struct("idx", *"ltrb"))).alias("cells"))
    joined = clusters.select(*PAGE, "id", "label", *"ltrb", "conf").join(own, [*PAGE, "id"], "left")
    empty = "array<struct<idx:int,l:double,t:double,r:double,b:double>>"
    joined = joined.withColumn("cells", F.coalesce("cells", F.array().cast(empty))).withColumn("is_orphan", F.lit(False))
    if not options.keep_empty_clusters:
        joined = joined.filter((F.size("cells") > 0) | (F.col("label") == "formula"))
    if options.create_orphan_clusters:
        extra = orphans(places, dets)
        extra = extra.withColumn("cells", F.array(F.struct("idx", *"ltrb")).cast(empty)).withColumn("is_orphan", F.lit(True)).drop("idx")
        joined = joined.unionByName(extra)
    return joined.withColumn("ord", F.col("id"))


def _tight() -> dict[str, Column]:
    low = {c: F.coalesce(F.array_min(F.transform("cells", member(c))), F.col(c)) for c in "lt"}
    high = {c: F.coalesce(F.array_max(F.transform("cells", member(c))), F.col(c)) for c in "rb"}
    return low | high


def tightened(clusters: DataFrame) -> DataFrame:
    """Boxes drawn in to the union of their cells; empty clusters keep theirs."""
    return clusters.withColumns(_tight())


#: Clusters to a tile, about; a page of fewer than four times as many is one tile.
TILE = 16


def tiled(clusters: DataFrame) -> DataFrame:
    """Clusters by the tiles that they touch and that of their centre (``home``): ``tx``, ``ty`` in a grid of the page's clusters of a class.
    Those whose sides are the wrong way round touch none (``whole`` is false).
    """
    page = Window.partitionBy(*PAGE, "cls")
    side = F.greatest(F.floor(F.sqrt(F.count("*").over(page) / TILE)), F.lit(1))
    own = clusters.withColumns({"side": side, "x0": F.min("l").over(page), "y0": F.min("t").over(page), "x1": F.max("r").over(page), "y1": F.max("b").over(page)})

    def place(at: Column, axis: str) -> Column:
        part = F.try_divide(at - F.col(f"{axis}0"), F.col(f"{axis}1") - F.col(f"{axis}0"))
        return F.greatest(F.least(F.floor(F.coalesce(part, F.lit(0.0)) * F.col("side")), F.col("side") - 1), F.lit(0))

    own = own.withColumns({"cx": place((F.col("l") + F.col("r")) / 2, "x"), "cy": place((F.col("t") + F.col("b")) / 2, "y"), "whole": F.coalesce(F.expr("l <= r and t <= b"), F.lit(False))})

    def touched(low: str, high: str, axis: str, centre: str) -> Column:
        return F.when(F.col("whole"), F.sequence(place(F.col(low), axis), place(F.col(high), axis))).otherwise(F.array(centre))

    own = own.withColumn("tx", F.explode(touched("l", "r", "x", "cx"))).withColumn("ty", F.explode(touched("t", "b", "y", "cy")))
    return own.withColumn("home", (F.col("tx") == F.col("cx")) & (F.col("ty") == F.col("cy"))).drop("side", "x0", "y0", "x1", "y1", "cx", "cy")


def overlap_pairs(clusters: DataFrame) -> DataFrame:
    """``(page, cls, a, b)``, a < b: clusters of a class that overlap strongly; two orphans never do.

    Of two that do, the smaller one lies by over four fifths in the larger one, so its centre does: each pair is found once, in the
    one tile of that centre. Boxes are dealt once, by page; a tile's boxes are a row, as there are few of them.
    """
    found = tiled(clusters.select(*PAGE, "cls", "id", "is_orphan", *"ltrb"))
    tiles = found.groupBy(*PAGE, "cls", "tx", "ty").agg(F.collect_list(F.struct("id", "is_orphan", *"ltrb", "home", "whole")).alias("boxes"))
    x, y = F.col("x"), F.col("y")
    free = ~(x["is_orphan"] & y["is_orphan"])
    small, large = area(fields(x)), area(fields(y))
    smaller = (small < large) | (small == large) & (x["id"] < y["id"])
    pairs = tiles.filter(F.size("boxes") > 1).select(*PAGE, "cls", "boxes", F.explode("boxes").alias("x")).filter(x["home"]).select(*PAGE, "cls", "x", F.explode("boxes").alias("y"))
    pairs = pairs.filter(y["whole"] & (x["id"] != y["id"]) & smaller & free & overlaps(fields(x), fields(y)))
    return pairs.select(*PAGE, "cls", F.least(x["id"], y["id"]).alias("a"), F.greatest(x["id"], y["id"]).alias("b"))


#: Pairs of a page up to which its groups are folded in one row.
FOLDED = 64
KEY = (*PAGE, "cls")


def group_roots(pairs: DataFrame) -> DataFrame:
    """``(page, cls, id, root)``: for all members of pairs (stored, as they are read several times) the smallest id of their group."""
    counted = Window.partitionBy(*KEY)
    sized = pairs.withColumn("n", F.count("*").over(counted))
    pages = sized.filter(F.col("n") <= FOLDED).groupBy(*KEY).agg(F.collect_list(F.array("a", "b")).alias("edges"))
    parts = merged_sets(F.array_distinct(F.flatten("edges")), F.col("edges"))
    roots = pages.select(*KEY, F.explode(parts).alias("part")).select(*KEY, F.explode("part").alias("id"), F.array_min("part").alias("root"))
    dense = sized.filter(F.col("n") > FOLDED)
    if dense.isEmpty():
        return roots
    node = lambda c: F.struct(*KEY, F.col(c).alias("id"))
    found = connected_components(dense.select(node("a").alias("src"), node("b").alias("dst")))
    return roots.unionByName(found.select(*(F.col(f"node.{k}").alias(k) for k in KEY), F.col("node.id").alias("id"), F.col("component.id").alias("root")))


def preferred(candidate: Column, other: Column, ratio_limit: Column, conf_limit: Column) -> Column:
    """Whether a box stands against another: list items over like texts, code over what it holds, else by size and confidence."""
    a, b = area(fields(candidate)), area(fields(other))
    ratio = F.try_divide(a, b)
    item = (candidate["label"] == "list_item") & (other["label"] == "text") & (F.abs(1 - ratio) < 0.2)
    code = (candidate["label"] == "code") & (over_self(fields(other), fields(candidate)) > CONTAINED)
    yields = (ratio <= ratio_limit) & (other["conf"] - candidate["conf"] > conf_limit)
    return F.coalesce(item, F.lit(False)) | F.coalesce(code, F.lit(False)) | ~F.coalesce(yields, F.lit(False))


def _limits(cls: Column, which: int) -> Column:
    out = F.lit(PREFER["regular"][which])
    for name in ("picture", "wrapper"):
        out = F.when(cls == name, PREFER[name][which]).otherwise(out)
    return out


MEMBER = ("ord", "id", "label", "l", "t", "r", "b", "conf", "is_orphan", "cells")


def _labelled(clusters: DataFrame, pairs: DataFrame | None) -> DataFrame:
    """Clusters with the ``root`` of their group; null where they overlap none."""
    return clusters.join(group_roots(stored(overlap_pairs(clusters), "overlaps") if pairs is None else pairs), [*KEY, "id"], "left")


def grouped(clusters: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """``(page, cls, members)``: connected groups of strongly overlapping clusters, also of one, members in list order."""
    own = _labelled(clusters, pairs)
    groups = own.groupBy(*KEY, F.coalesce("root", "id").alias("root")).agg(F.sort_array(F.collect_list(F.struct(*MEMBER))).alias("members"))
    return groups.drop("root")


def winner(members: Column, cls: Column) -> Column:
    """Of the members that stand against all others, the largest by a fold that guards confidence; else the first."""
    ratio_limit, conf_limit = _limits(cls, 0), _limits(cls, 1)
    stands = F.filter(members, lambda c: F.forall(members, lambda o: (o["id"] == c["id"]) | preferred(c, o, ratio_limit, conf_limit)))

    def fold(best, c):
        better = (area(fields(c)) > area(fields(best))) & (best["conf"] - c["conf"] <= conf_limit)
        return F.when(better, c).otherwise(best)

    rest = F.slice(stands, 2, F.greatest(F.size(stands), F.lit(1)))
    return F.when(F.size(stands) > 0, F.aggregate(rest, F.get(stands, F.lit(0)), fold)).otherwise(F.get(members, F.lit(0)))


def merged(clusters: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """One cluster of each group, with the cells of all, in the place of the group's first; ``joined`` tells those of several."""
    own = _labelled(clusters, pairs)
    columns = (*PAGE, "id", "label", *"ltrb", "conf", "cells", "is_orphan", "ord", "cls")
    alone = own.filter("root is null").select(*columns, F.lit(False).alias("joined"))
    groups = own.filter("root is not null").groupBy(*KEY, "root").agg(F.sort_array(F.collect_list(F.struct(*MEMBER))).alias("members"))
    cells = F.array_sort(F.array_distinct(F.flatten(F.transform("members", lambda m: m["cells"]))))
    first = F.array_min(F.transform("members", lambda m: m["ord"]))
    # a generator of one row: the winner is worked out once, not once for each of its fields
    best = groups.select(*KEY, cells.alias("cells"), first.alias("ord"), F.explode(F.array(winner(F.col("members"), F.col("cls")))).alias("best"))
    best = best.select(*PAGE, *(F.col(f"best.{c}").alias(c) for c in ("id", "label", *"ltrb", "conf")), "cells", F.col("best.is_orphan").alias("is_orphan"), "ord", "cls", F.lit(True).alias("joined"))
    return alone.unionByName(best)


def refined(clusters: DataFrame, passes: int = 3) -> DataFrame:
    """Tighten and merge until nothing changes, ``passes`` times at most.

    After the first pass only clusters that came of a merge can have changed, so only pairs with one of them are looked for, on
    pages that have one. Every pass that merges writes its clusters; one that finds no pair ends the work.
    """
    out = stored(clusters.withColumn("cls", F.lit("regular")).withColumns(_tight()).withColumn("joined", F.lit(True)), "tight-clusters")
    for done in range(passes):
        live = out.join(out.filter("joined").select(*PAGE).distinct(), list(PAGE), "left_semi") if done else out
        pairs = stored(overlap_pairs(live), "overlaps")
        if pairs.isEmpty():
            break
        out = merged(out, pairs)
        if done < passes - 1:
            out = stored(out.withColumns(_tight()), "merged-clusters")
    return out.drop("joined")


def without_table_twins(specials: DataFrame, regulars: DataFrame) -> DataFrame:
    """Specials but those wrappers that lie almost wholly in a regular table and are not clearly surer of themselves.

    Tables are special themselves, so no regular cluster is one and nothing goes; the rule is kept for other label sets.
    """
    s, r = specials.alias("s"), regulars.filter("label = 'table'").alias("r")
    twin = [F.col("s.label").isin(*WRAPPERS), over_self(box("s."), box("r.")) > TWIN, F.col("s.conf") - F.col("r.conf") < TWIN_CONFIDENCE]
    return s.join(r, [*on_page("s", "r"), *twin], "left_anti")


def children(specials: DataFrame, regulars: DataFrame) -> DataFrame:
    """``(page, parent_id, child_id, ...)``: regular clusters more than four fifths inside a special one."""
    s, r = specials.alias("s"), regulars.alias("r")
    pairs = s.join(r, [*on_page("s", "r"), over_self(box("r."), box("s.")) > CONTAINED])
    return pairs.select("s.doc_id", "s.page_no", F.col("s.id").alias("parent_id"), F.col("r.id").alias("child_id"), *(F.col(f"r.{c}").alias(c) for c in "ltrb"), F.col("r.cells").alias("cells"), F.col("r.label").alias("child_label"))


def not_full_page(specials: DataFrame, pages: DataFrame) -> DataFrame:
    """Without pictures over nine tenths of their page."""
    joined = specials.join(pages.select(*PAGE, "width", "height"), list(PAGE))
    page_area = F.col("width") * F.col("height")
    full = (F.col("label") == "picture") & (page_area > 0) & (F.try_divide(area(box()), page_area) > FULL_PAGE)
    return joined.filter(~full).drop("width", "height")


def special_boxes(specials: DataFrame, kids: DataFrame) -> DataFrame:
    """Specials with the cells of their children; forms and key-value regions take the union of their children's boxes."""
    empty = "array<struct<idx:int,l:double,t:double,r:double,b:double>>"
    own = kids.groupBy(*PAGE, F.col("parent_id").alias("id")).agg(
        F.min("l").alias("cl"), F.min("t").alias("ct"), F.max("r").alias("cr"), F.max("b").alias("cb"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("cells")))).alias("cells")
    )
    joined = specials.drop("cells").join(own, [*PAGE, "id"], "left")
    loose = F.col("label").isin("form", "key_value_region")
    boxes = {c: F.when(loose, F.coalesce(f"c{c}", c)).otherwise(F.col(c)) for c in "ltrb"}
    return joined.withColumns(boxes).withColumn("cells", F.coalesce("cells", F.array().cast(empty))).drop("cl", "ct", "cr", "cb")


def deoverlapped(specials: DataFrame) -> DataFrame:
    """Pictures and wrappers, each class among its own."""
    own = specials.withColumn("cls", box_class()).withColumn("is_orphan", F.lit(False)).withColumn("ord", F.col("id"))
    return merged(own).drop("joined")


def final(regulars: DataFrame, specials: DataFrame, kids: DataFrame) -> DataFrame:
    """Regular clusters outside every surviving special one, and the specials."""
    alive = kids.join(specials.select(*PAGE, F.col("id").alias("parent_id")), [*PAGE, "parent_id"], "left_semi")
    inside = alive.select(*PAGE, F.col("child_id").alias("id")).distinct()
    return regulars.join(inside, [*PAGE, "id"], "left_anti").unionByName(specials, allowMissingColumns=True)


def ordered(clusters: DataFrame, mode: str = "id") -> DataFrame:
    """Adds ``pos`` from zero: by first cell (none: last), or top to bottom, or left to right."""
    by = {"id": [F.coalesce(F.array_min(F.transform("cells", lambda x: x["idx"])).cast("double"), F.lit(float("inf"))), F.col("t"), F.col("l")], "tblr": [F.col("t"), F.col("l")], "lrtb": [F.col("l"), F.col("t")]}[mode]
    order = Window.partitionBy(*PAGE).orderBy(*by, "id")
    return clusters.withColumn("pos", (F.row_number().over(order) - 1).cast("int"))


def page_scores(clusters: DataFrame, cells: DataFrame, pages: DataFrame) -> DataFrame:
    """Mean confidence of clusters and of OCR cells; null where there are none."""
    layout = clusters.groupBy(*PAGE).agg(F.avg("conf").alias("layout_score"))
    ocr = cells.filter("from_ocr").groupBy(*PAGE).agg(F.avg("conf").alias("ocr_score"))
    return pages.select(*PAGE).join(layout, list(PAGE), "left").join(ocr, list(PAGE), "left")


def clean(dets: DataFrame, cells: DataFrame, pages: DataFrame, options: LayoutOptions = LayoutOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Refined regular clusters, special ones with their boxes and cells, and the children that link them.

    All are read several times from here on, so they are written to the shared folder once.
    """
    kept = gated(ingest(dets))
    regular = remapped(kept.filter(~is_special()))
    if options.skip_cell_assignment:
        none = "array<struct<idx:int,l:double,t:double,r:double,b:double>>"
        regular = regular.select(*PAGE, "id", "label", *"ltrb", "conf").withColumn("cells", F.array().cast(none)).withColumn("is_orphan", F.lit(False)).withColumn("ord", F.col("id"))
    else:
        regular = with_cells(regular, cells, dets, options)
    regular = stored(refined(regular, options.passes), "regular-clusters")
    special = not_full_page(kept.filter(is_special()).select(*PAGE, "id", "label", *"ltrb", "conf"), pages)
    special = without_table_twins(special, regular)
    kids = stored(children(special, regular), "children")
    return regular, stored(special_boxes(special, kids), "special-clusters"), kids


def postprocess(dets: DataFrame, cells: DataFrame, pages: DataFrame, options: LayoutOptions = LayoutOptions()) -> DataFrame:
    """The whole clean-up: ``clusters`` of every page in reading position."""
    regular, special, kids = clean(dets, cells, pages, options)
    return ordered(final(regular, deoverlapped(special), kids))
