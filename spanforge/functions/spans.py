"""Column expressions on intervals and boxes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def iou(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Intersection over union of two intervals, 0 when both are empty."""
    inter = F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
    union = F.greatest(e1 - s1, F.lit(0)) + F.greatest(e2 - s2, F.lit(0)) - inter
    return F.when(union > 0, inter.cast("double") / union).otherwise(F.lit(0.0))


def midpoint(s: Column, e: Column) -> Column:
    return F.lit(0.5) * (s + e)


def overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Length of the overlap; negative when apart."""
    return F.least(e1, e2) - F.greatest(s1, s2)


def box_center(lo: Column, hi: Column) -> Column:
    return (lo + hi) / 2


def boxes_overlap(ax1, ay1, ax2, ay2, bx1, by1, bx2, by2) -> Column:
    """True when two boxes share an area (touching edges do not count)."""
    return (ax1 < bx2) & (bx1 < ax2) & (ay1 < by2) & (by1 < ay2)


def expand_box(x1, y1, x2, y2, factor: float) -> tuple[Column, Column, Column, Column]:
    """Scale a box about its centre."""
    cx, cy = box_center(x1, x2), box_center(y1, y2)
    hw, hh = (x2 - x1) / 2 * factor, (y2 - y1) / 2 * factor
    return cx - hw, cy - hh, cx + hw, cy + hh


def clamp01(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0)))
