"""Reading order of pages with any number of columns, by recursive cuts.

A region is cut from side to side at its gutters where what lies left and right stands side by side, and from top to bottom
elsewhere. Bands of a region that have a gutter in common stay together, so that columns whose lines happen to align are
not read across. Only boxes reach the Python workers; a page is one unit, whose work grows with its boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE = ("doc_id", "page_no")
FURNITURE = ("page_header", "page_footer")
HEADINGS = ("section_header", "title")


def runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Numbers, ascending along the axis, of the groups of intervals that overlap; those that only touch do not."""
    order = np.lexsort((high, low))
    reach = np.maximum.accumulate(high[order])
    out = np.empty(len(low), dtype=np.int64)
    out[order] = np.concatenate(([0], np.cumsum(low[order][1:] >= reach[:-1])))
    return out


def _extents(group: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval that each group covers."""
    first, last = np.full(group.max() + 1, np.inf), np.full(group.max() + 1, -np.inf)
    np.minimum.at(first, group, low)
    np.maximum.at(last, group, high)
    return first, last


def _sections(bands: np.ndarray, left: np.ndarray, right: np.ndarray, heading: np.ndarray) -> np.ndarray:
    """Numbers of the sections of a region without a gutter of its own: each takes bands as long as they have a gutter in common.

    A section needs a band that has a gutter by itself, or its bands stand alone; a heading at the end of one belongs to what follows.
    """
    members = np.split(np.argsort(bands, kind="stable"), np.cumsum(np.bincount(bands))[:-1])
    own = [_extents(runs(left[m], right[m]), left[m], right[m]) for m in members]
    sections, shared = [[0]], own[0]
    for k in range(1, len(members)):
        low, high = np.concatenate((shared[0], own[k][0])), np.concatenate((shared[1], own[k][1]))
        joined = _extents(runs(low, high), low, high)
        if len(joined[0]) > 1:
            sections[-1].append(k)
            shared = joined
        else:
            sections.append([k])
            shared = own[k]
    final = []
    for section in sections:
        tail = []
        while section is not sections[-1] and len(section) > 1 and len(own[section[-1]][0]) == 1 and heading[members[section[-1]]].all():
            tail.insert(0, [section.pop()])
        final += [section] if any(len(own[k][0]) > 1 for k in section) else [[k] for k in section]
        final += tail
    number = np.empty(len(members), dtype=np.int64)
    for n, section in enumerate(final):
        number[section] = n
    return number[bands]


def page_order(boxes: np.ndarray, heading: np.ndarray, slack: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Place and column of each box ``(l, t, r, b)``, in order of ``id`` where all else is equal.

    Columns are numbered as they are read: the number grows whenever reading moves into or out of a column. Boxes are drawn in by
    ``slack`` on each side, a quarter of their size at most. Boxes without four finite sides come last, in the order given.
    """
    boxes = np.asarray(boxes, dtype=float).reshape(-1, 4)
    usable = np.isfinite(boxes).all(axis=1)
    left, top, right, bottom = np.minimum(boxes[:, 0], boxes[:, 2]), np.minimum(boxes[:, 1], boxes[:, 3]), np.maximum(boxes[:, 0], boxes[:, 2]), np.maximum(boxes[:, 1], boxes[:, 3])
    inset_x, inset_y = np.minimum(slack, (right - left) / 4), np.minimum(slack, (bottom - top) / 4)
    left, right, top, bottom = left + inset_x, right - inset_x, top + inset_y, bottom - inset_y
    place, column = np.empty(len(boxes), dtype=np.int64), np.empty(len(boxes), dtype=np.int64)
    todo, made, told, number, last = [(np.flatnonzero(usable), 0)], 1, 0, 0, 0
    while todo:
        own, token = todo.pop()
        parts, sideways = None, False
        if len(own) > 1:
            across = runs(left[own], right[own])
            if across.max():
                side_by_side = runs(*_extents(across, top[own], bottom[own]))
                sideways = not side_by_side.max()
                parts = across if sideways else side_by_side[across]
            else:
                bands = runs(top[own], bottom[own])
                parts = _sections(bands, left[own], right[own], heading[own]) if bands.max() else None
        if parts is None:
            for k in own[np.lexsort((left[own], top[own]))]:
                number += token != last
                last = token
                place[k], column[k] = told, number
                told += 1
            continue
        pieces = np.split(own[np.argsort(parts, kind="stable")], np.cumsum(np.bincount(parts))[:-1])
        tokens = range(made, made + len(pieces)) if sideways else [token] * len(pieces)
        made += len(pieces) if sideways else 0
        todo += list(zip(pieces, tokens, strict=True))[::-1]
    rest = np.flatnonzero(~usable)
    place[rest], column[rest] = np.arange(told, len(boxes)), number
    return place, column


def reading_order(elements: DataFrame, pages: DataFrame, slack: float = 1.0) -> DataFrame:
    """As ``reading.reading_order``, but the body in the order of its cuts: adds ``width``, ``height``, ``zone``, ``column`` and ``seq``.

    Elements are told apart by ``(doc_id, page_no, id)``; rows that repeat one share its place. Page headers and footers take no part
    in the cuts. Pages without elements give no rows.
    """

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = batch.column("blocks")
            sizes, flat = np.diff(blocks.offsets.to_numpy()), blocks.flatten()
            boxes = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in "ltrb"], axis=1)
            heading = flat.field("heading").to_numpy(zero_copy_only=False).astype(bool)
            ends = np.cumsum(sizes)
            told = [page_order(boxes[a:b], heading[a:b], slack) for a, b in zip(ends - sizes, ends, strict=True)]
            keys = batch.select(list(PAGE)).take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
            places = (np.concatenate([x[k] for x in told] or [np.empty(0, dtype=np.int64)]) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([*keys.columns, flat.field("id"), *map(pa.array, places)], [*PAGE, "id", "place", "column"])

    own = elements.join(pages.select(*PAGE, "width", "height"), list(PAGE), "left")
    label = F.coalesce(F.col("label"), F.lit(""))
    types = {f.name: f.dataType.simpleString() for f in elements.schema}
    body = elements.filter(~label.isin(*FURNITURE)).select(*PAGE, "id", *(F.col(c).cast("double").alias(c) for c in "ltrb"), label.isin(*HEADINGS).alias("heading"))
    schema = ", ".join(f"{c} {types[c]}" for c in (*PAGE, "id")) + ", place long, column long"
    blocks = F.array_sort(F.collect_list(F.struct("id", *"ltrb", "heading"))).alias("blocks")
    places = body.dropDuplicates([*PAGE, "id"]).groupBy(*PAGE).agg(blocks).mapInArrow(ordered, schema)
    zone = F.when(label == "page_header", 0).when(label == "page_footer", 2).otherwise(1)
    out = own.join(places, [*PAGE, "id"], "left").withColumn("zone", zone).withColumn("column", F.coalesce("column", F.lit(0)).cast("int"))
    within = Window.partitionBy(*PAGE).orderBy("zone", F.col("place").asc_nulls_first(), "t", "l", "id")
    before = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, -1)
    # numbers run on from page to page by a sum over pages, so that no task holds the elements of a whole document
    starts = elements.groupBy(*PAGE).agg(F.count("*").alias("n")).select(*PAGE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    out = out.join(starts, list(PAGE)).withColumn("seq", (F.col("start") + F.row_number().over(within) - 1).cast("int"))
    return out.drop("place", "start")
