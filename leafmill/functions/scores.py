"""Confidence scores and grades; null stands for "no score"."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lower bounds of the grades.
GRADES = ((0.9, "excellent"), (0.8, "good"), (0.5, "fair"))


def grade(score: Column) -> Column:
    """Null first: comparisons with NaN would make it excellent."""
    out = F.when(score.isNull() | F.isnan(score), "unspecified")
    for bound, name in GRADES:
        out = out.when(score >= bound, name)
    return out.otherwise("poor")


def coerced(text: Column) -> Column:
    """A score from text; what is no number (empty, nan, null, none) is no score."""
    number = text.try_cast("double")
    return F.when(F.isnan(number), None).otherwise(number)


def present(*scores: Column) -> Column:
    return F.array_sort(F.filter(F.array(*scores), lambda x: x.isNotNull()))


def mean_of(*scores: Column) -> Column:
    own = present(*scores)
    return F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), F.size(own))


def quantile_of(q: float, *scores: Column) -> Column:
    """Linear-interpolation quantile of the scores that are there."""
    own = present(*scores)
    at = F.lit(q) * (F.size(own) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(own, low), F.get(own, low + 1)
    return a + F.coalesce((b - a) * (at - low), F.lit(0.0))
