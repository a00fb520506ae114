"""Fitting text into boxes with a deterministic measure: East Asian characters are 1 em wide, others 0.55."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructField, StructType

#: Signs that may not begin a line, and that may not end one.
NO_START, NO_END = "，。、；：！？）》」』】,.;:!?)]}%", "（《「『【"
#: Letter spacings in em, in the order in which they are tried; share of the box height at which sizes start; line height; the factor between sizes.
SPACINGS, FILL, LINE_HEIGHT, STEP = (0.0, -0.012, -0.025, -0.04), 0.92, 1.02, 0.92
#: A small overflow is sought below this share of the first size, and is at most so many characters and this share of the width.
MINOR_BELOW, MINOR_CHARS, MINOR_SHARE = 0.8, 2, 0.12
#: Shapes that a worker remembers, of texts of at most so many characters: short texts come again in boxes of the same size.
REMEMBERED, SHORT = 32_768, 64


def is_wide(c: str) -> bool:
    return any(lo <= c <= hi for lo, hi in (("　", "ヿ"), ("一", "鿿"), ("＀", "￯")))


def _width(wide: int, length: int, size: float, spacing: float) -> float:
    return size * (0.45 * wide + 0.55 * length) + spacing * size * max(0, length - 1)


def measure(text: str, size: float, spacing: float = 0.0) -> float:
    return _width(0 if text.isascii() else sum(map(is_wide, text)), len(text), size, spacing)


def wrap(text: str, width: float, size: float, spacing: float = 0.0) -> list[str]:
    """Greedy wrapping by character; a closing sign is pulled up, an opening one pushed down, a blank at a break dropped.

    Wide characters are counted once, so the width of any stretch of the text is a difference of two counts.
    """
    if not text or not width > 0:
        return [text] if text else []
    wide = list(accumulate(map(is_wide, text), initial=0))
    lines, start = [], 0
    for i, c in enumerate(text):
        if i <= start or _width(wide[i + 1] - wide[start], i + 1 - start, size, spacing) <= width:
            continue
        if c in NO_START:
            lines.append(text[start : i + 1])
            start = i + 1
        elif text[i - 1] in NO_END:
            lines.append(text[start : i - 1])
            start = i - 1
        else:
            lines.append(text[start:i])
            start = i + 1 if c == " " else i
    return [*lines, text[start:]] if start < len(text) else lines


@dataclass(frozen=True)
class Limits:
    """What a text may take: sizes, height and width, and the stretch that its block must stay in (None: around its box)."""

    smallest: float = 6.0
    largest: float | None = None
    from_largest: bool = False
    allow_h: float | None = None
    allow_w: float | None = None
    top: float | None = None
    bottom: float | None = None
    minor_chars: int = MINOR_CHARS


def sizes(h: float, limits: Limits) -> list[float]:
    """Whole sizes to try, falling by ``STEP`` from what the box height or the largest size says down to the smallest."""
    start = math.floor(h * FILL)
    if limits.largest and math.isfinite(limits.largest):
        start = math.floor(limits.largest) if limits.from_largest else min(start, limits.largest)
    out = [max(start, limits.smallest)]
    while out[-1] > limits.smallest and len(out) < 40:
        out.append(math.floor(out[-1] * STEP))
    return out


@lru_cache(REMEMBERED)
def _shaped(text: str, w: float, h: float, least: float, largest: float | None, from_largest: bool, allow_h: float | None, allow_w: float | None, minor_chars: int) -> tuple[dict, float, float]:
    """What of ``fit`` does not hang on the place: the shape, the height of its box and the room."""
    w, h = max(1.0, w), max(1.0, h)
    limits = Limits(smallest=least, largest=largest, from_largest=from_largest, allow_h=allow_h, allow_w=allow_w, minor_chars=minor_chars)
    room, ladder = max(h, limits.allow_h or h), sizes(h, limits)
    most_w = math.inf if limits.allow_w is None else limits.allow_w

    def shape(size: float, spacing: float, width: float) -> dict:
        lines = wrap(text, width, size, spacing)
        widest = max((measure(t, size, spacing) for t in lines), default=0.0)
        return {"lines": lines, "font_size": float(size), "spacing": spacing, "line_height": size * LINE_HEIGHT, "block_h": len(lines) * size * LINE_HEIGHT, "widest": widest}

    def first(tried: list[float], width) -> dict | None:
        every = (shape(size, spacing, width(size)) for size in tried for spacing in SPACINGS)
        return next((s for s in every if s["block_h"] <= room and s["widest"] <= width(s["font_size"]) + 0.5), None)

    found, over_w = first(ladder, lambda _: w), False
    if found is None or found["font_size"] < ladder[0] * MINOR_BELOW:
        larger = [s for s in ladder if found is None or s > found["font_size"]]
        wider = first(larger, lambda size: max(w, min(most_w, w + limits.minor_chars * size, w * (1 + MINOR_SHARE))))
        if wider is not None:
            found, over_w = wider, wider["widest"] > w + 0.5
    over = found is None
    out = (found or shape(least, SPACINGS[-1], w)) | {"overflow": over, "overflow_x": over_w}
    return out | {"shrunk": out["font_size"] < ladder[0], "tightened": out["spacing"] < 0}, h, room


def shaped(text: str, w: float, h: float, limits: Limits) -> tuple[dict, float, float]:
    shape = _shaped if len(text) <= SHORT else _shaped.__wrapped__
    return shape(text, w, h, max(4.0, limits.smallest or 6.0), limits.largest, limits.from_largest, limits.allow_h, limits.allow_w, limits.minor_chars)


def placed(y: float, h: float, room: float, block_h: float, top: float | None = None, bottom: float | None = None) -> float:
    """Where a block of lines begins: in the middle of its box, within its room."""
    low = y - (room - h) / 2 if top is None else top
    high = low + room if bottom is None else bottom
    return min(max(y + (h - block_h) / 2, low), max(low, high - block_h))


def fit(text: str, x: float, y: float, w: float, h: float, limits: Limits = Limits()) -> dict:
    """The largest size at which the text fits its limits, trying tighter spacing before a smaller size.

    If that is below ``MINOR_BELOW`` of the first size, or nothing fits, a larger size that overflows the width a little (``MINOR_CHARS`` characters,
    ``MINOR_SHARE`` of it, never past ``allow_w``) is preferred. If that fails too, the smallest size at the tightest spacing overflows.
    """
    out, h, room = shaped(text, w, h, limits)
    return out | {"x": x, "y": placed(y, h, room, out["block_h"], limits.top, limits.bottom)}


KIND = "struct<lines:array<string>,font_size:double,spacing:double,line_height:double,block_h:double,widest:double,overflow:boolean,overflow_x:boolean,shrunk:boolean,tightened:boolean,x:double,y:double>"
FIELDS = "lines font_size spacing line_height block_h widest overflow overflow_x shrunk tightened x y".split()


def known(v) -> float | None:
    return None if v is None or pd.isna(v) else float(v)


def lay_out(items: DataFrame) -> DataFrame:
    """``items`` (text, x, y, w, h, allow_h, allow_w) with a ``layout`` struct."""

    kept = [f for f in items.schema if f.name != "layout"]
    schema = StructType([*kept, StructField("layout", DataType.fromDDL(KIND))])
    shape = to_arrow_schema(schema).field("layout").type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = lambda c: [math.nan if v is None else float(v) for v in b.column(c).to_pylist()]
            numbers, seen, shapes, which, ys = [column(c) for c in ("x", "y", "w", "h", "allow_h", "allow_w")], {}, [], [], []
            for text, _, y, w, h, allow_h, allow_w in zip(b.column("text").to_pylist(), *numbers, strict=True):
                key = (text, w, h, allow_h, allow_w)
                i = seen.get(key)
                if i is None:
                    i = seen[key] = len(shapes)
                    shapes.append(shaped(text or "", w, h, Limits(allow_h=known(allow_h), allow_w=known(allow_w))))
                which.append(i)
                out, high, room = shapes[i]
                ys.append(placed(y, high, room, out["block_h"]))
            made = {"x": pa.array(numbers[0], pa.float64()), "y": pa.array(ys, pa.float64())}
            made |= {f.name: pa.array([s[0][f.name] for s in shapes], f.type).take(pa.array(which, pa.int32())) for f in shape if f.name not in made}
            layout = pa.StructArray.from_arrays([made[f.name] for f in shape], fields=list(shape))
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), layout], names=schema.names)

    return items.mapInArrow(run, schema)


def page_line_height(items: DataFrame) -> DataFrame:
    """Upper median of a page's item heights, by which outliers are normalised before layout."""
    s = F.sort_array(F.collect_list("h"))
    per = items.groupBy("page").agg(F.get(s, F.floor(F.size(s) / 2).cast("int")).alias("median_h"))
    even = F.when(F.col("h").between(F.col("median_h") * 0.7, F.col("median_h") * 1.4), F.col("median_h")).otherwise(F.col("h"))
    return items.join(per, "page").withColumn("even_h", even)
