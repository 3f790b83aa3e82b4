"""Boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def corners_to_xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.array(x1, y1, x2 - x1, y2 - y1)


def xywh_to_corners(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.array(x, y, x + w, y + h)


def scaled_1000(value: Column, whole: Column) -> Column:
    """Share of ``whole`` in thousandths, half to even; null where ``whole`` is 0."""
    return F.bround(value / F.nullif(whole, F.lit(0.0)) * 1000, 0).cast("int")


def area(w: Column, h: Column) -> Column:
    return w * h


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two (x, y, w, h) arrays; 0 for boxes without area."""
    at = lambda c, i: F.get(c, i)
    wide = F.least(at(a, 0) + at(a, 2), at(b, 0) + at(b, 2)) - F.greatest(at(a, 0), at(b, 0))
    high = F.least(at(a, 1) + at(a, 3), at(b, 1) + at(b, 3)) - F.greatest(at(a, 1), at(b, 1))
    inner = F.greatest(wide, F.lit(0.0)) * F.greatest(high, F.lit(0.0))
    union = at(a, 2) * at(a, 3) + at(b, 2) * at(b, 3) - inner
    return F.when(union > 0, inner / union).otherwise(0.0)
