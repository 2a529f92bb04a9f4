"""Boxes as columns: a box is struct<x0,y0,x1,y1> of double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.model import PAPER_MM


def box(x0, y0, x1, y1) -> Column:
    cols = [c if isinstance(c, Column) else F.col(c) if isinstance(c, str) else F.lit(c) for c in (x0, y0, x1, y1)]
    return F.struct(*(c.cast("double").alias(n) for c, n in zip(cols, ("x0", "y0", "x1", "y1"))))


def box_of(a: Column) -> Column:
    """From an array of four numbers."""
    return box(*(F.get(a, k) for k in range(4)))


def as_array(b: Column) -> Column:
    return F.array(b.x0, b.y0, b.x1, b.y1)


def width(b: Column) -> Column:
    return b.x1 - b.x0


def height(b: Column) -> Column:
    return b.y1 - b.y0


def center_x(b: Column) -> Column:
    return (b.x0 + b.x1) / 2


def center_y(b: Column) -> Column:
    return (b.y0 + b.y1) / 2


def _not_below_zero(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def area(b: Column) -> Column:
    return _not_below_zero(width(b)) * _not_below_zero(height(b))


def intersection(a: Column, b: Column) -> Column:
    return _not_below_zero(F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0)) * _not_below_zero(F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))


def overlaps(a: Column, b: Column) -> Column:
    """Boxes that share area: the residual predicate of every overlap join, beside its page key."""
    return (a.x0 < b.x1) & (b.x0 < a.x1) & (a.y0 < b.y1) & (b.y0 < a.y1)


def containment(a: Column, b: Column) -> Column:
    """The share of a that lies in b."""
    return intersection(a, b) / F.greatest(area(a), F.lit(1e-6))


def iou(a: Column, b: Column) -> Column:
    i = intersection(a, b)
    u = area(a) + area(b) - i
    return F.when(u > 0, i / u).otherwise(0.0)


def shrink(b: Column, share: float = 0.08) -> Column:
    dx, dy = width(b) * share, height(b) * share
    return box(b.x0 + dx, b.y0 + dy, b.x1 - dx, b.y1 - dy)


def clip(b: Column, w: Column, h: Column) -> Column:
    z = F.lit(0.0)
    return box(F.least(F.greatest(b.x0, z), w), F.least(F.greatest(b.y0, z), h), F.least(F.greatest(b.x1, z), w), F.least(F.greatest(b.y1, z), h))


def scale(b: Column, sx: Column, sy: Column) -> Column:
    return box(b.x0 * sx, b.y0 * sy, b.x1 * sx, b.y1 * sy)


def union_agg(b: Column) -> Column:
    """Aggregate: the bounding box."""
    return F.struct(F.min(b.x0).alias("x0"), F.min(b.y0).alias("y0"), F.max(b.x1).alias("x1"), F.max(b.y1).alias("y1"))


def band(b: Column, page_width: Column) -> Column:
    """left, center or right third of a letterhead strip."""
    c = center_x(b) / page_width
    return F.when(c < 0.36, "left").when(c > 0.64, "right").otherwise("center")


def order_points(points: Column) -> Column:
    """Four points as top left, top right, bottom right, bottom left: by the extremes of x + y and y - x."""
    by = lambda f, best: best(F.transform(points, lambda p: F.struct(f(p).alias("k"), p.alias("p")))).p
    add, sub = (lambda p: F.get(p, 0) + F.get(p, 1)), (lambda p: F.get(p, 1) - F.get(p, 0))
    return F.array(by(add, F.array_min), by(sub, F.array_min), by(add, F.array_max), by(sub, F.array_max))


def snap_paper(w: Column, h: Column) -> Column:
    """struct(paper, width_mm, height_mm) for a page's proportions."""
    ratio = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1e-9))
    upright = h >= w
    size = lambda name, a, b: F.struct(F.lit(name).alias("paper"), F.when(upright, a).otherwise(b).alias("width_mm"), F.when(upright, b).otherwise(a).alias("height_mm"))
    a4, letter = PAPER_MM["A4"], PAPER_MM["Letter"]
    is_letter = F.abs(ratio / (letter[1] / letter[0]) - 1) < 0.015
    free = F.struct(F.lit(None).cast("string").alias("paper"), F.when(upright, 210.0).otherwise(297.0).alias("width_mm"), (F.when(upright, 210.0).otherwise(297.0) * h / w).alias("height_mm"))
    return F.when(is_letter, size("Letter", *map(F.lit, letter))).when(ratio.between(1.25, 1.50), size("A4", *map(F.lit, a4))).otherwise(free)


def is_text_line(b: Column, ink_area: Column, page_width: Column) -> Column:
    """Lines of a plausible height and width that are not almost empty."""
    w, h = width(b), height(b)
    return (h >= 0.006 * page_width) & (h <= 0.08 * page_width) & (w >= 0.012 * page_width) & (ink_area >= 0.06 * w * h)


def is_coloured_blob(b: Column, ink_area: Column, w: Column, h: Column) -> Column:
    bw, bh = width(b), height(b)
    return (bw >= 0.03 * w) & (bh >= 0.008 * h) & (ink_area >= 0.0005 * w * h) & (bw * bh <= 0.2 * w * h) & (ink_area / F.greatest(bw * bh, F.lit(1.0)) >= 0.01)


def is_text_group(b: Column, ink_fill: Column, w: Column, h: Column) -> Column:
    return (area(b) >= 0.0008 * w * h) & (ink_fill >= 0.04)


def blob_type(w: Column, h: Column, page_width: Column, components: Column, longest_stroke: Column) -> Column:
    """What a coloured blob is: round and large a stamp, one long stroke a signature, else a note."""
    ratio = w / F.greatest(h, F.lit(1.0))
    stamp = (ratio > 0.7) & (ratio < 1.4) & (w > 0.08 * page_width)
    signature = (longest_stroke > 0.55 * w) & (components <= 4) & (w > 0.1 * page_width)
    return F.when(stamp, "stamp").when(signature, "signature").otherwise("handwritten_note")
