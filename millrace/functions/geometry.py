"""Boxes as columns: area, overlap, containment, padding. A box is (x1, y1, x2, y2)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def box(prefix: str = "", suffix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{n}{suffix}") for n in ("x1", "y1", "x2", "y2"))


def area(b) -> Column:
    """max(0, width * height): two negative sides give a positive area."""
    x1, y1, x2, y2 = map(_c, b)
    return F.greatest(F.lit(0.0), (x2 - x1) * (y2 - y1))


def intersection(a, b) -> Column:
    ax1, ay1, ax2, ay2 = map(_c, a)
    bx1, by1, bx2, by2 = map(_c, b)
    w, h = F.least(ax2, bx2) - F.greatest(ax1, bx1), F.least(ay2, by2) - F.greatest(ay1, by1)
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def _sides(b) -> Column:
    x1, y1, x2, y2 = map(_c, b)
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a, b) -> Column:
    inter = intersection(a, b)
    union = _sides(a) + _sides(b) - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(0.0)


def contained(a, b) -> Column:
    """The share of box a that box b covers; an area under 1 counts as 1."""
    return intersection(a, b) / F.greatest(F.lit(1.0), (_c(a[2]) - _c(a[0])) * (_c(a[3]) - _c(a[1])))


def padded(x, y, w, h, img_w: float | Column, img_h: float | Column, share: float) -> dict[str, Column]:
    """x, y, w, h grown by a share of their size (rounded half to even) and clipped to the image."""
    x, y, w, h = map(_c, (x, y, w, h))
    pw, ph = F.bround(w * share), F.bround(h * share)
    left, top = F.greatest(F.lit(0.0), x - pw), F.greatest(F.lit(0.0), y - ph)
    right, bottom = (F.lit(v).cast("double") for v in (img_w, img_h))
    return {"x": left, "y": top, "w": F.least(right, x + w + pw) - left, "h": F.least(bottom, y + h + ph) - top}


def crop_scale(w, h, least: int = 256, most: int = 1024, cap: float = 4.0) -> Column:
    """Factor that brings the short side to ``least`` (at most ``cap`` times) and the long side to ``most``."""
    short, long = F.least(_c(w), _c(h)), F.greatest(_c(w), _c(h))
    up = F.when(short < least, F.least(F.lit(cap), F.lit(float(least)) / F.greatest(short, F.lit(1.0)))).otherwise(1.0)
    return F.when(long * up > most, F.lit(float(most)) / long).otherwise(up)


def corners(points) -> dict[str, Column]:
    """Of an array of structs (x, y): top left, top right, bottom right, bottom left by x + y and y - x."""
    by = lambda key, last: F.element_at(F.array_sort(F.transform(points, lambda p: F.struct(key(p).alias("k"), p["x"].alias("x"), p["y"].alias("y")))), -1 if last else 1)
    plus, minus = (lambda p: p["x"] + p["y"]), (lambda p: p["y"] - p["x"])
    return {"tl": by(plus, False), "tr": by(minus, False), "br": by(plus, True), "bl": by(minus, True)}


def corner_points(x: Column, y: Column) -> dict[str, Column]:
    """``corners`` as aggregates over rows: the points (struct v, x, y; v the value compared) with the least and greatest x + y and y - x, ties going to the
    least x, then y. No group is gathered."""
    point = lambda v: F.struct(v.alias("v"), x.alias("x"), y.alias("y"))
    last = lambda v: F.min(F.struct((-v).alias("v"), x.alias("x"), y.alias("y")))
    return {"tl": F.min(point(x + y)), "tr": F.min(point(y - x)), "br": last(x + y), "bl": last(y - x)}
