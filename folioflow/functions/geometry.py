"""Box arithmetic as columns. A box is four columns: left, top, width, height; y runs downwards."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Box(NamedTuple):
    x: Column
    y: Column
    w: Column
    h: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in "xywh"))

    @classmethod
    def corners(cls, x0: Column, y0: Column, x1: Column, y1: Column) -> Box:
        return cls(x0, y0, x1 - x0, y1 - y0)

    @property
    def right(self) -> Column:
        return self.x + self.w

    @property
    def bottom(self) -> Column:
        return self.y + self.h

    def as_struct(self) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip("xywh", self, strict=True)))


def clamp(v: Column, low, high) -> Column:
    return F.least(F.greatest(v, _lit(low)), _lit(high))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def area(b: Box) -> Column:
    return F.greatest(b.w, F.lit(0)) * F.greatest(b.h, F.lit(0))


def centre(b: Box) -> tuple[Column, Column]:
    return b.x + b.w / 2, b.y + b.h / 2


def contains(b: Box, px: Column, py: Column) -> Column:
    """Borders belong to the box."""
    return px.between(b.x, b.right) & py.between(b.y, b.bottom)


def union(a: Box, b: Box) -> Box:
    return Box.corners(F.least(a.x, b.x), F.least(a.y, b.y), F.greatest(a.right, b.right), F.greatest(a.bottom, b.bottom))


def expand(b: Box, pad, page_w, page_h) -> Box:
    """``b`` grown by ``pad`` on every side and cut off at the page."""
    return Box.corners(clamp(b.x - pad, 0, page_w), clamp(b.y - pad, 0, page_h), clamp(b.right + pad, 0, page_w), clamp(b.bottom + pad, 0, page_h))


def overlap_x(a: Box, b: Box) -> Column:
    return F.least(a.right, b.right) - F.greatest(a.x, b.x)


def overlap_y(a: Box, b: Box) -> Column:
    return F.least(a.bottom, b.bottom) - F.greatest(a.y, b.y)


def intersects(a: Box, b: Box) -> Column:
    """Boxes that only touch do not intersect."""
    return (overlap_x(a, b) > 0) & (overlap_y(a, b) > 0)


def shared_area(a: Box, b: Box) -> Column:
    return F.when(intersects(a, b), overlap_x(a, b) * overlap_y(a, b)).otherwise(F.lit(0))


def iou(a: Box, b: Box) -> Column:
    both = shared_area(a, b)
    whole = area(a) + area(b) - both
    return F.when(whole > 0, both / whole).otherwise(F.lit(0.0))


def overlap_ratio(a: Box, b: Box) -> Column:
    """Shared area as a part of the smaller box."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, shared_area(a, b) / least).otherwise(F.lit(0.0))


def normalise_1000(v: list[Column]) -> Column:
    """Corner numbers on a 0-1000 scale: fractions (all under 2) are scaled up, signs dropped, 1080 is the
    most, corners are put in order and each side is at least 6. Null when a number is missing or not finite."""
    bad = F.lit(False)
    for c in v:
        bad = bad | c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    scale = F.when(F.greatest(*v) < 2, 1000.0).otherwise(1.0)
    a = [F.least(F.abs(c * scale), F.lit(1080.0)) for c in v]
    x0, y0 = F.least(a[0], a[2]), F.least(a[1], a[3])
    x1, y1 = F.greatest(a[0], a[2], x0 + 6), F.greatest(a[1], a[3], y0 + 6)
    return F.when(~bad, F.array(x0, y0, x1, y1))


def map_from_crop(box: Column, off_x, off_y, src_w, src_h, page_w, page_h) -> Box:
    """A 0-1000 box of a crop in page pixels; it does not depend on the crop's zoom. A null box becomes the
    fallback at the crop's corner; results are clamped and at least 2 pixels wide and high."""
    off_x, off_y, src_w, src_h, page_w, page_h = map(_lit, (off_x, off_y, src_w, src_h, page_w, page_h))
    side = clamp(F.least(page_w, page_h) * 0.025, 24.0, 200.0)
    spans = []
    for lo, hi, off, size, page, fall in ((0, 2, off_x, src_w, page_w, side), (1, 3, off_y, src_h, page_h, F.greatest(F.lit(12.0), side / 2))):
        a = clamp(F.when(box.isNull(), off).otherwise(off + box[lo] / 1000 * size), 0.0, page)
        b = clamp(F.when(box.isNull(), off + fall).otherwise(off + box[hi] / 1000 * size), 0.0, page)
        thin = b <= a + 1
        end = F.when(thin, F.least(page, a + 2)).otherwise(b)
        spans.append((F.when(thin, F.greatest(F.lit(0.0), F.least(a, end - 2))).otherwise(a), end))
    return Box.corners(spans[0][0], spans[1][0], spans[0][1], spans[1][1])


def crop_for_region(b: Box, page_w, page_h) -> dict[str, Column]:
    """Padded crop of a region and the zoom at which it is read."""
    longest = F.greatest(b.w, b.h)
    pad = F.greatest(F.lit(4.0), F.floor(longest * 0.12 + 0.5))
    e = expand(b, pad, page_w, page_h)
    side = F.greatest(e.w, e.h)
    zoom = clamp(640 / side, 1.0, 4.0)
    return {"x": e.x, "y": e.y, "w": e.w, "h": e.h, "pad": pad, "scale": F.when(side * zoom > 1400, F.greatest(1400 / side, F.lit(0.0))).otherwise(zoom)}


def page_size(px_w: Column, px_h: Column, pt_w: Column, pt_h: Column, scale: Column) -> dict[str, Column]:
    """Page size in points and its resolution: as given, else pixels / scale, else 72 dpi."""
    given, scaled = (pt_w > 0) & (pt_h > 0), scale > 0
    given, scaled = F.coalesce(given, F.lit(False)), F.coalesce(scaled, F.lit(False))
    return {
        "w_pt": F.when(given, pt_w).when(scaled, px_w / scale).otherwise(px_w),
        "h_pt": F.when(given, pt_h).when(scaled, px_h / scale).otherwise(px_h),
        "dpi": F.when(given, 72 * px_w / pt_w).when(scaled, 72 * scale).otherwise(F.lit(72.0)),
        "exact": given | scaled,
    }


def map_rect(b: Box, scale, pad, page_w, page_h) -> Box:
    """A box of a scaled page on the whole page: padded, rounded outwards, cut to the page, at least one pixel."""
    x0, y0 = F.greatest(F.lit(0.0), F.floor((b.x - pad) * scale)), F.greatest(F.lit(0.0), F.floor((b.y - pad) * scale))
    x1, y1 = F.least(_lit(page_w), F.ceil((b.right + pad) * scale)), F.least(_lit(page_h), F.ceil((b.bottom + pad) * scale))
    return Box(x0, y0, F.greatest(F.lit(1.0), x1 - x0), F.greatest(F.lit(1.0), y1 - y0))


def fallback_size(page_w: Column, page_h: Column) -> tuple[Column, Column]:
    """Width and height of a box that a reader gave no place: 2.5 per cent of the page's short side, between 24 and 200."""
    short = F.greatest(F.lit(1.0), F.least(page_w, page_h))
    s = F.floor(clamp(short * 0.025, 24.0, 200.0) + 0.5)
    return s, F.greatest(F.lit(12), F.floor(s * 0.5 + 0.5))


def dilation_width(height: Column) -> Column:
    """Odd width of the brush that joins the letters of a line of this height."""
    v = F.floor(F.least(F.lit(25.0), F.greatest(F.lit(3.0), F.floor(height * 0.6 + 0.5).cast("double"))) + 0.5)
    return F.when(v % 2 == 0, v + 1).otherwise(v)


def tiles(page_w: Column, page_h: Column, most: float = 1600.0) -> Column:
    """Overlapping tiles (x, y, w, h) of a page, row by row; one tile where the page is no larger than 86 per cent of ``most``."""
    target = float(int(most * 0.86 + 0.5))
    cols, rows = F.greatest(F.lit(1), F.ceil(page_w / target)), F.greatest(F.lit(1), F.ceil(page_h / target))
    tw, th = F.ceil(page_w / cols), F.ceil(page_h / rows)
    lap = F.floor(F.least(tw, th) * 0.12 + 0.5)
    start = lambda i, size: F.greatest(F.lit(0), i * size - F.when(i > 0, lap).otherwise(0)).cast("double")
    stop = lambda i, size, n, end: F.least(end, ((i + 1) * size + F.when(i < n - 1, lap).otherwise(0)).cast("double"))

    def one(r: Column, c: Column) -> Column:
        x, y = start(c, tw), start(r, th)
        return F.struct(x.alias("x"), y.alias("y"), (stop(c, tw, cols, page_w) - x).alias("w"), (stop(r, th, rows, page_h) - y).alias("h"))

    every = F.flatten(F.transform(F.sequence(F.lit(0), rows - 1), lambda r: F.transform(F.sequence(F.lit(0), cols - 1), lambda c: one(r, c))))
    return F.when((cols == 1) & (rows == 1), every).otherwise(F.filter(every, lambda t: (t["w"] >= 32) & (t["h"] >= 32)))


def region_score(ink: Column, w: Column, h: Column, lines: Column) -> Column:
    """How much a region looks like text: the evenness of its ink and its number of lines."""
    even = F.when((ink / (w * h)).between(0.06, 0.62), 1.0).otherwise(0.35)
    return F.least(F.lit(1.0), 0.5 * even + 0.12 * F.least(lines, F.lit(6)))
