"""Column functions over boxes (x1, y1, x2, y2 as four columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def box(alias: str = "", prefix: str = "") -> tuple[Column, Column, Column, Column]:
    dot = f"{alias}." if alias else ""
    return tuple(F.col(f"{dot}{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def area(b) -> Column:
    return F.greatest(F.lit(0.0), b[2] - b[0]) * F.greatest(F.lit(0.0), b[3] - b[1])


def intersection(a, b) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def overlaps(a, b) -> Column:
    """With a common inner point."""
    return (F.greatest(a[0], b[0]) < F.least(a[2], b[2])) & (F.greatest(a[1], b[1]) < F.least(a[3], b[3]))


def iou(a, b) -> Column:
    """Intersection over union; null if a box is missing, 0 if they only touch."""
    known = F.lit(True)
    for c in (*a, *b):
        known = known & c.isNotNull()
    common = intersection(a, b)
    return F.when(known, F.when(common <= 0, 0.0).otherwise(F.try_divide(common, area(a) + area(b) - common)))


def horizontal_overlap(a, b) -> Column:
    """Common width over the smaller width; 0 for boxes without width."""
    wa, wb = F.greatest(F.lit(0.0), a[2] - a[0]), F.greatest(F.lit(0.0), b[2] - b[0])
    common = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    return F.when((wa <= 0) | (wb <= 0), 0.0).otherwise(F.try_divide(common, F.least(wa, wb)))


def height(b) -> Column:
    return F.greatest(F.lit(0.0), b[3] - b[1])


def caption_rank(c, o) -> Column:
    """0 for a caption below its object, 1 for any other."""
    return F.when(c[1] >= o[3], 0).otherwise(1)


def caption_distance(c, o) -> Column:
    return F.when(c[1] >= o[3], c[1] - o[3]).otherwise(F.greatest(F.lit(0.0), o[1] - c[3]))


def line_height(median: Column) -> Column:
    return F.coalesce(F.greatest(F.lit(1.0), median), F.lit(12.0))


def caption_reach(median: Column) -> Column:
    return F.greatest(F.lit(24.0), line_height(median) * 1.5)


def note_reach(median: Column) -> Column:
    return F.greatest(F.lit(32.0), line_height(median) * 2.5)


def margin_zone(y1: Column, y2: Column, page_height: Column) -> Column:
    """top or bottom tenth of the page, null inside or without a page height."""
    return F.when(page_height > 0, F.when(y1 <= page_height * 0.10, "top").when(y2 >= page_height * (1 - 0.10), "bottom"))
