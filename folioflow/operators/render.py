"""From translated items to what is drawn: which items, at which size, in which cover, in which colours, and a page's statistics."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .layout import FIELDS, KIND, Limits, fit, known

#: How much larger than its ink a text is set, the least readable size, and the page's soft bounds around its median.
GROW, READABLE, SOFT_HIGH, SOFT_LOW, COMFORT = 1.35, 11.0, 1.2, 0.75, 10
#: Colours of fields by kind.
FIELD_COLOURS = {"label": (26, 79, 138), "code": (138, 26, 92), "note": (31, 111, 58)}


def fate(dst: Column, src: Column, w: Column, h: Column) -> Column:
    """Why an item is not drawn: ``empty``, ``same`` or ``failed``; null if it is."""
    said = F.coalesce(dst, F.lit(""))
    sized = F.coalesce(w > 0, F.lit(False)) & F.coalesce(h > 0, F.lit(False))
    return F.when(said == "", "empty").when(said == F.coalesce(src, F.lit("")), "same").when(~sized, "failed")


def even_ink(items: DataFrame) -> DataFrame:
    """``items`` (page, ink struct<x,y,w,h,line_height,line_count,alignment>) with line heights that agree, and ``median_h`` of the page.

    A line height far from height over count is replaced by that mean; then one far from the page's upper median by the median.
    """
    ink, mean = F.col("ink"), F.col("ink.h") / F.col("ink.line_count")
    off = (mean > 0) & ((ink["line_height"] > 1.45 * mean) | (ink["line_height"] < 0.55 * mean))
    once = F.when(
        F.coalesce(off, F.lit(False)),
        ink.withField("line_height", mean).withField("line_count", F.greatest(F.lit(1), F.floor(ink["h"] / F.greatest(F.lit(4.0), mean) + 0.5).cast("int"))),
    ).otherwise(ink)
    items = items.withColumn("ink", once)
    heights = F.sort_array(F.collect_list(F.when(F.col("ink.line_height") > 0, F.col("ink.line_height"))))
    per = items.groupBy("page").agg(F.coalesce(F.get(heights, F.floor(F.size(heights) / 2).cast("int")), F.lit(0.0)).alias("median_h"))
    items = items.join(per, "page")
    ratio, median = F.col("ink.line_height") / F.col("median_h"), F.col("median_h")
    far = (median > 4) & (ink["line_height"] > 0) & ((ratio >= 1.8) | (ratio <= 0.45))
    lines = F.greatest(F.lit(1), F.floor(ink["h"] / median + 0.5).cast("int"))
    return items.withColumn("ink", F.when(F.coalesce(far, F.lit(False)), ink.withField("line_height", median).withField("line_count", lines)).otherwise(ink))


def size_cap(text_h: Column, font_height: Column, line_height: Column, median: Column, grow: float = GROW, readable: float = READABLE) -> Column:
    """The largest size of an item: what its font or ink says, its box, and soft bounds of its page; null if nothing is known."""
    em = F.when(F.coalesce(font_height > 0, F.lit(False)), font_height).when(F.coalesce(line_height > 0, F.lit(False)), line_height / 0.72)
    by_em = em * grow
    own = F.least(by_em, F.greatest(text_h * 1.15, F.lit(readable)))
    high = F.greatest(by_em, median * grow * SOFT_HIGH)
    low = F.greatest(F.lit(readable), F.least(by_em, median * grow * SOFT_LOW))
    page_low = F.greatest(F.lit(readable), median * grow * 0.72)
    of_page = F.when(median > 0, F.greatest(page_low + 2, median * grow * 1.28))
    return F.when(em.isNull(), of_page).when(median > 4, F.when(own < low, low).when(own > high, high).otherwise(own)).otherwise(own)


def _half_up(v: float) -> int:
    return math.floor(v + 0.5)


class _Item:
    """One item on its way to a place: its text box, the width at which it is wrapped, and what its cover may take."""

    def __init__(self, r: dict, smallest: float):
        self.r, self.ink, self.smallest = r, r["ink"], smallest
        box = self.ink if self.ink is not None else r
        self.x, self.y, self.w, self.h = (float(box[k]) for k in "xywh")
        self.align = self.ink["alignment"] if self.ink is not None else "left"
        self.room = {
            "left": r["right"] - self.x, "center": 2 * (r["right"] - (self.x + self.w / 2)), "right": r["right"] - r["left"],
        }[self.align]
        self.room = max(1.0, self.room)
        self.wrap_w = self.w
        if self.align == "left" and self.room > self.w:
            self.wrap_w += max(0.0, min(known(r["free"]) or 0.0, 2 * self.w, self.room - self.w))
        if r["median_h"] > 4 and len(r["dst"]) >= 8:
            self.wrap_w = max(self.wrap_w, min(r["median_h"] * GROW * COMFORT, self.room))

    def laid(self, width: float, allow_h: float, allow_w: float, height: float | None = None, strict: bool = True) -> dict:
        r = self.r
        limits = Limits(
            smallest=self.smallest, largest=known(r["size_cap"]), from_largest=True, allow_h=allow_h, allow_w=allow_w, top=r["top"], bottom=r["bottom"],
            **({"minor_chars": 0} if strict else {}),
        )
        return fit(r["dst"], self.x, self.y, width, self.h if height is None else height, limits)

    def narrow(self, width: float) -> dict:
        return self.laid(max(8.0, width), self.r["allow_h"], max(1.0, width))

    def drawn_at(self, l: dict) -> float:
        """Where lines begin, by the alignment of what they replace."""
        if self.ink is None or l["widest"] <= 0 or self.align == "left":
            return l["x"]
        return self.x + (self.w - l["widest"]) / (2 if self.align == "center" else 1)

    def reference(self) -> tuple[float, float, float, float]:
        """What the cover must hide: the measured ink alone where the item's box is a reader's guess or far larger, else both."""
        r, ink = self.r, self.ink
        own = (r["x"], r["y"], r["x"] + r["w"], r["y"] + r["h"])
        if ink is None:
            return own
        seen = (ink["x"], ink["y"], ink["x"] + ink["w"], ink["y"] + ink["h"])
        if "vision" in (r["engine"] or "").lower() or max(1.0, r["w"] * r["h"]) > 2 * max(1.0, ink["w"] * ink["h"]):
            return seen
        return tuple(pick(a, b) for pick, a, b in zip((min, min, max, max), own, seen, strict=True))

    def cover(self, l: dict, at: float) -> tuple[float, float, float, float]:
        """x, y, w, h of the stretch that is painted over and drawn into; neighbours bound it."""
        x0, y0, x1, y1 = self.reference()
        pad_x, pad_y, r = max(3, _half_up((y1 - y0) * 0.25)), max(3, _half_up((y1 - y0) * 0.3)), self.r
        left, top = max(min(x0, at) - pad_x, r["left"]), max(min(y0, l["y"]) - pad_y, r["top"])
        right = min(max(x1, at + max(0.0, l["widest"])) + pad_x, r["right"])
        bottom = min(max(y1, l["y"] + l["block_h"]) + pad_y, r["bottom"])
        right = right if right > left else min(left + 1, r["right"])
        bottom = bottom if bottom > top else min(top + 1, r["bottom"])
        return left, top, right - left, bottom - top


def place(r: dict, smallest: float = 6.0) -> dict:
    """Layout, start and cover of one item: near the number of lines of what it replaces, and laid again where its cover is too small."""
    item = _Item(r, smallest)
    laid = item.laid(item.wrap_w, r["allow_h"], item.room, strict=False)
    lines = item.ink["line_count"] if item.ink is not None else 0
    if lines >= 2 and len(laid["lines"]) != lines:
        for width in (item.ink["w"] * 0.95, item.ink["w"] * 1.15, item.ink["w"] * 1.4, item.wrap_w):
            other = item.narrow(min(width, item.room)) if width > 8 else laid
            nearer = abs(len(other["lines"]) - lines) < abs(len(laid["lines"]) - lines)
            if nearer and other["font_size"] >= 0.92 * laid["font_size"]:
                laid = other
    at, again = item.drawn_at(laid), 0
    cover = item.cover(laid, at)
    if laid["widest"] > cover[2] + 0.5:
        other = item.narrow(max(8.0, cover[2]))
        if other["widest"] <= cover[2] + 0.5 or other["widest"] < laid["widest"]:
            laid, at, again = other, item.drawn_at(other), again + 1
            cover = item.cover(laid, at)
    if laid["block_h"] > cover[3] + 0.5:
        other = item.laid(max(8.0, min(item.wrap_w, item.room)), max(cover[3], r["allow_h"]), item.room, cover[3])
        if other["block_h"] <= cover[3] + 0.5 or other["block_h"] < laid["block_h"]:
            laid, at, again = other, item.drawn_at(other), again + 1
            cover = item.cover(laid, at)
    if 0 < laid["widest"] <= cover[2]:
        at = min(max(at, cover[0]), cover[0] + cover[2] - laid["widest"])
    return {"layout": laid, "draw_x": at, "cover": dict(zip("xywh", cover, strict=True)), "relayout": again}


PLACE = f"struct<layout:{KIND},draw_x:double,cover:struct<x:double,y:double,w:double,h:double>,relayout:int>"
INK = "struct<x:double,y:double,w:double,h:double,line_height:double,line_count:int,alignment:string>"
NEEDS = ("x", "y", "w", "h", "dst", "engine", "free", "median_h", "size_cap", "top", "bottom", "left", "right", "allow_h", "ink")


def place_items(items: DataFrame, smallest: float = 6.0) -> DataFrame:
    """``items`` that are to be drawn, with ``place``; they carry ``NEEDS`` (sizes, limits of their neighbours, evened ink or null)."""

    @F.pandas_udf(PLACE)
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in rows.to_dict("records"):
            r["ink"] = None if r["ink"] is None or r["ink"].get("w") is None else r["ink"]
            p = place(r | {"engine": r["engine"] or ""}, smallest)
            out.append(p | {"layout": {k: p["layout"][k] for k in FIELDS}})
        return pd.DataFrame(out, columns=["layout", "draw_x", "cover", "relayout"])

    return items.withColumn("place", run(F.struct(*[F.col(c) for c in NEEDS])))


def render_plan(items: DataFrame, limits: DataFrame, largest: float | None = None) -> DataFrame:
    """All ``items`` (page, no, x, y, w, h, src, dst, engine, font_height, ink, free) with their ``fate`` and, if drawn, ``size_cap`` and ``place``.

    ``limits`` (page, no, top, bottom, left, right, allow_h) are those of the drawn items among each other.
    """
    items = items.withColumn("fate", fate(F.col("dst"), F.col("src"), F.col("w"), F.col("h")))
    drawn = even_ink(items.where("fate IS NULL")).join(limits, ["page", "no"])
    text_h = F.coalesce(F.col("ink.h"), F.col("h"))
    cap = size_cap(text_h, F.col("font_height"), F.col("ink.line_height"), F.col("median_h"))
    cap = F.least(cap, F.lit(largest)) if largest is not None else cap
    drawn = place_items(drawn.withColumn("size_cap", cap))
    rest = items.where("fate IS NOT NULL")
    return drawn.select("page", "no", "fate", "size_cap", "place").unionByName(rest.select("page", "no", "fate"), allowMissingColumns=True)


def render_statistics(plan: DataFrame) -> DataFrame:
    """How many items of each page were drawn, left out and why, shrunk, overflowing, laid again."""
    is_ = lambda name: F.count_if(F.col("fate") == name)
    return plan.groupBy("page").agg(
        F.count("*").alias("total"), F.count_if(F.col("fate").isNull()).alias("drawn"), is_("empty").alias("skipped_empty"), is_("same").alias("skipped_same"), is_("failed").alias("failed"),
        F.count_if(F.col("place.layout.shrunk")).alias("shrunk"), F.count_if(F.col("place.layout.overflow")).alias("overflow"), F.coalesce(F.sum("place.relayout"), F.lit(0)).alias("relayout"),
    )


def field_colour(text: Column, sampled: Column, dark: Column) -> Column:
    """Colour of a text by its kind of field; on dark ground, and for other kinds, the sampled one."""
    kind, out = T.classify_field(text), sampled
    for name, colour in FIELD_COLOURS.items():
        out = F.when(kind == name, F.array(*map(F.lit, colour))).otherwise(out)
    return F.when(dark, sampled).otherwise(out)


# Ground ---------------------------------------------------------------------------------------------------------------

def median_colour(pixels: np.ndarray) -> np.ndarray:
    """Upper median of each channel; white where there is nothing."""
    flat = pixels.reshape(-1, 3)
    return np.sort(flat, axis=0)[len(flat) // 2].astype(np.int64) if len(flat) else np.array([255, 255, 255])


def luminance(rgb: np.ndarray) -> np.ndarray:
    return rgb @ np.array([0.299, 0.587, 0.114])


def sample_ground(rgb: np.ndarray, x: float, y: float, w: float, h: float) -> dict:
    """The ground around a box, as two to six rows of colours from its upper to its lower edge, and the colour of the text in it.

    The first and last row come from three pixels above and below the box, those between from one and four pixels beside it, and
    from inside only where a page has no such pixels. Text is what differs by 45 in lightness; coloured strokes go before gray ones.
    """
    high, wide = rgb.shape[:2]
    x0, y0 = min(max(_half_up(x), 0), wide - 1), min(max(_half_up(y), 0), high - 1)
    x1, y1 = min(max(_half_up(x + w), x0 + 1), wide), min(max(_half_up(y + h), y0 + 1), high)
    inner = rgb[y0:y1, x0:x1].astype(np.int64)
    n, rows = min(max(_half_up(inner.shape[0] / 18) + 1, 2), 6), []
    above = rgb[max(y0 - 4, max(0, y0 - 9)), x0:x1] if y0 else None
    below = rgb[min(y1 + 3, min(y1 + 9, high) - 1), x0:x1] if y1 < high else None

    def beside(at: int) -> np.ndarray | None:
        sides = []
        if x0:
            sides.append([rgb[at, x0 - 1], rgb[at, max(x0 - 4, max(0, x0 - 7))]])
        if x1 < wide:
            sides.append([rgb[at, x1], rgb[at, min(x1 + 3, min(x1 + 7, wide) - 1)]])
        return median_colour(np.array([median_colour(np.array(s)) for s in sides])) if sides else None

    for i in range(n):
        at = _half_up(i / (n - 1) * (inner.shape[0] - 1))
        ends = (above, below) if i == 0 else (below, above) if i == n - 1 else (beside(y0 + at),)
        found = next((e for e in ends if e is not None), inner[at])
        rows.append(np.broadcast_to(found, inner[0].shape).astype(np.int64))
    every = np.concatenate(rows)
    ground = median_colour(every)
    dark = bool(luminance(ground) < 95)
    varied = float(np.abs(every - ground).mean()) if len(every) > 1 else 0.0
    light = luminance(inner)
    ink = inner[light > luminance(ground) + 45] if dark else inner[light < luminance(ground) - 45]
    text = np.array([245] * 3 if dark else [24] * 3)
    if len(ink) >= max(6, inner.shape[0] * inner.shape[1] / 400):
        vivid = ink[ink.max(axis=1) - ink.min(axis=1) > 42]
        vivid, share = (vivid, 0.95) if len(vivid) >= max(4, 0.25 * len(ink)) else (ink, 0.92)
        text = median_colour(vivid)
        text = text if dark else np.floor(text * share + 0.5).astype(np.int64)
    return {"rows": np.array(rows), "uniform": varied < 6, "colour": ground, "dark": dark, "text": text}


def paint_ground(rgb: np.ndarray, x: float, y: float, w: float, h: float, ground: dict) -> np.ndarray:
    """The page with a box painted in its sampled ground: one colour, or rows blended into each other down the box."""
    out, high, wide = rgb.copy(), *rgb.shape[:2]
    x0, y0, n_x, n_y = _half_up(x), _half_up(y), max(1, _half_up(w)), max(1, _half_up(h))
    ys, xs = np.arange(max(0, y0), min(high, y0 + n_y)), np.arange(max(0, x0), min(wide, x0 + n_x))
    if not len(ys) or not len(xs):
        return out
    if ground["uniform"]:
        out[np.ix_(ys, xs)] = ground["colour"]
        return out
    rows = ground["rows"].astype(np.float64)
    at = np.clip((ys - y0 + 0.5) * len(rows) / n_y - 0.5, 0, len(rows) - 1)
    low = np.minimum(np.floor(at).astype(int), len(rows) - 2)
    part = (at - low)[:, None, None]
    columns = np.minimum(xs - x0, rows.shape[1] - 1)
    out[np.ix_(ys, xs)] = np.rint(rows[low][:, columns] * (1 - part) + rows[low + 1][:, columns] * part)
    return out
