"""Boxes and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(box: Column) -> Column:
    return (box["x2"] - box["x1"]) * (box["y2"] - box["y1"])


def intersection(a: Column, b: Column) -> Column:
    """Shared area of two boxes; 0 if they don't meet."""
    wide = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    high = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    return F.greatest(wide, F.lit(0)) * F.greatest(high, F.lit(0))


def valid_box(box: Column) -> Column:
    return F.coalesce((box["x1"] < box["x2"]) & (box["y1"] < box["y2"]), F.lit(False))


def iou(a: Column, b: Column) -> Column:
    """I10 as a fraction (shared, union): exact until the last division; invalid or null boxes share 0 of 1."""
    shared = intersection(a, b)
    good = valid_box(a) & valid_box(b)
    return F.struct(F.when(good, shared).otherwise(F.lit(0)).cast("long").alias("shared"), F.when(good, area(a) + area(b) - shared).otherwise(F.lit(1)).cast("long").alias("union"))


def product(shape: Column) -> Column:
    """Elements of a tensor of this shape; a scalar has 1."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def float32(x: Column) -> Column:
    """Rounded to single precision, with -0.0 as 0.0."""
    f = x.cast("float")
    return F.when(f == 0, F.lit(0.0).cast("float")).otherwise(f)


def contiguous_strides(shape: Column) -> Column:
    """Elements between neighbours along each axis of a contiguous tensor: the product of the sizes behind it."""
    return F.transform(shape, lambda _, i: F.aggregate(F.slice(shape, i + 2, F.size(shape)), F.lit(1).cast("long"), lambda a, x: a * x))
