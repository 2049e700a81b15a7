"""Boxes as four double columns (l, t, r, b), origin top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{s}") for s in "ltrb")


def fields(x: Column) -> tuple[Column, Column, Column, Column]:
    """The box in a struct column."""
    return tuple(x[s] for s in "ltrb")


def area(b) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a, b) -> Column:
    width = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def over_self(a, b) -> Column:
    """Part of ``a`` inside ``b``; null for an empty ``a``."""
    return F.try_divide(intersection(a, b), area(a))


def iou(a, b) -> Column:
    inter = intersection(a, b)
    return F.try_divide(inter, area(a) + area(b) - inter)


def overlaps(a, b, iou_above: float = 0.8, inside_above: float = 0.8) -> Column:
    """Strong overlap: by union or by containment either way; never for empty boxes."""
    some = (area(a) > 0) & (area(b) > 0)
    return some & ((iou(a, b) > iou_above) | (over_self(a, b) > inside_above) | (over_self(b, a) > inside_above))


def touches(a, b) -> Column:
    """Closed intersection: shared edges count."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def flipped(t: Column, page_height: Column) -> Column:
    return page_height - t


def expanded(b, factor: float):
    """Grown on each side by a part of its width and height."""
    w, h = (b[2] - b[0]) * factor, (b[3] - b[1]) * factor
    return b[0] - w, b[1] - h, b[2] + w, b[3] + h
