"""Joins, folds and clusterings of boxes on a page. The page is always the equi-key; a page's boxes are bounded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from .pages import per_page

ITEM = ("no", "x", "y", "w", "h", "src", "dst")


def pairs(boxes: DataFrame, page: str = "page", no: str = "no", ordered: bool = True) -> DataFrame:
    """Each two boxes of a page, columns suffixed ``_a`` and ``_b``: an equi-join on the page with the order as residual."""
    a = boxes.select(F.col(page), *[F.col(c).alias(f"{c}_a") for c in boxes.columns if c != page])
    b = boxes.select(F.col(page), *[F.col(c).alias(f"{c}_b") for c in boxes.columns if c != page])
    on = F.col(f"{no}_a") < F.col(f"{no}_b") if ordered else F.col(f"{no}_a") != F.col(f"{no}_b")
    return a.join(b, page).where(on)


def overlap_pairs(boxes: DataFrame, least: float = 0.3) -> DataFrame:
    a, b = Box_ab()
    return pairs(boxes).withColumn("ratio", G.overlap_ratio(a, b)).where(F.col("ratio") > least)


def grid_overlap_pairs(boxes: DataFrame, least: float = 0.3, cell: float = 256.0) -> DataFrame:
    """``overlap_pairs`` for pages with very many boxes: joined by grid cell, each pair kept in the cell of its shared corner alone."""
    span = lambda lo, size: F.sequence(F.floor(lo / cell), F.floor((lo + size) / cell))
    tiled = boxes.withColumn("cx", F.explode(span(F.col("x"), F.col("w")))).withColumn("cy", F.explode(span(F.col("y"), F.col("h"))))
    a = tiled.select("page", "cx", "cy", *[F.col(c).alias(f"{c}_a") for c in boxes.columns if c != "page"])
    b = tiled.select("page", "cx", "cy", *[F.col(c).alias(f"{c}_b") for c in boxes.columns if c != "page"])
    p, q = Box_ab()
    own = (F.floor(F.greatest(p.x, q.x) / cell) == F.col("cx")) & (F.floor(F.greatest(p.y, q.y) / cell) == F.col("cy"))
    found = a.join(b, ["page", "cx", "cy"]).where((F.col("no_a") < F.col("no_b")) & own)
    return found.drop("cx", "cy").withColumn("ratio", G.overlap_ratio(p, q)).where(F.col("ratio") > least)


def Box_ab() -> tuple[G.Box, G.Box]:
    return G.Box.of(suffix="_a"), G.Box.of(suffix="_b")


def merge_candidates(boxes: DataFrame, min_overlap_y: float = 0.55, max_height_ratio: float = 1.8, gap_ratio: float = 1.2, min_gap_ratio: float = -0.35) -> DataFrame:
    """Pairs of fragments on one line that may be merged: vertical overlap, like heights, and a gap in bounds."""
    a, b = Box_ab()
    low, high = F.least(a.h, b.h), F.greatest(a.h, b.h)
    gap = F.greatest(a.x, b.x) - F.least(a.right, b.right)
    fits = (G.overlap_y(a, b) >= min_overlap_y * low) & (high <= max_height_ratio * low) & (gap <= gap_ratio * high) & (gap >= min_gap_ratio * high)
    return pairs(boxes).withColumn("gap", gap).where(fits)


def neighbour_limits(boxes: DataFrame, page_w: float, page_h: float, gap: float = 3.0, grow: float = 1.35) -> DataFrame:
    """How far a box may grow before it meets its neighbours: conditional extremes of a left self-join."""
    a, b = Box_ab()
    own = boxes.select("page", *[F.col(c).alias(f"{c}_a") for c in ("no", "x", "y", "w", "h")])
    other = boxes.select("page", *[F.col(c).alias(f"{c}_b") for c in ("no", "x", "y", "w", "h")])
    joined = own.join(other, (own["page"] == other["page"]) & (F.col("no_a") != F.col("no_b")), "left").select(own["page"], *[f"{c}_{s}" for s in "ab" for c in ("no", "x", "y", "w", "h")])
    col, row = G.overlap_x(a, b) > 0, G.overlap_y(a, b) > 0
    spare = max(0.0, grow - 1)
    out = joined.groupBy("page", F.col("no_a").alias("no"), F.col("x_a").alias("x"), F.col("y_a").alias("y"), F.col("w_a").alias("w"), F.col("h_a").alias("h")).agg(
        F.max(F.when(col & (b.bottom <= a.y), b.bottom + gap)).alias("up"), F.min(F.when(col & (b.y >= a.bottom), b.y - gap)).alias("down"),
        F.max(F.when(row & (b.right <= a.x), b.right + gap)).alias("before"), F.min(F.when(row & (b.x >= a.right), b.x - gap)).alias("after"),
    )
    x, y, w, h = (F.col(c) for c in "xywh")
    top = F.least(F.greatest(y - spare * h / 2, F.col("up"), F.lit(0.0)), y)
    bottom = F.greatest(F.least(y + h + spare * h / 2, F.col("down"), F.lit(page_h)), y + h)
    left = F.least(F.greatest(F.col("before"), F.lit(0.0)), x)
    right = F.greatest(F.least(F.col("after"), F.lit(page_w)), x + w)
    return out.select("page", "no", top.alias("top"), bottom.alias("bottom"), left.alias("left"), right.alias("right"), F.greatest(F.lit(1.0), bottom - top).alias("allow_h"))


def box_fault(b: G.Box, ink: Column, glyph_h: Column, rows: Column | None = None, min_h: float = 6.0, max_h: float = 1e9) -> Column:
    """The first rule that a text box breaks, null if none."""
    density, aspect = ink / (b.w * b.h), b.w / b.h
    cap = F.when(glyph_h > 0, F.least(glyph_h * 2, F.lit(32.0))).otherwise(F.lit(0.0))
    small = (cap > 0) & (b.w <= cap) & (b.h <= cap)
    rules = [
        ("empty", ~((b.w >= 1) & (b.h >= 1))), ("too_short", b.h < min_h), ("too_tall", b.h > max_h), ("too_little_ink", ink < 3), ("density_low", density < 0.06),
        ("density_high", ~small & (density > 0.62)), ("too_narrow", aspect < 0.4), ("too_wide", aspect > 400),
    ] + ([("rows_sparse", rows < 0.25)] if rows is not None else [])
    out = F.lit(None).cast("string")
    for reason, broken in reversed(rules):
        out = F.when(broken, reason).otherwise(out)
    return out


def with_glyph_height(boxes: DataFrame) -> DataFrame:
    """The lower median of a page's box heights."""
    return boxes.join(boxes.groupBy("page").agg(F.percentile_disc(F.lit(0.5), F.col("h")).alias("glyph_h")) if hasattr(F, "percentile_disc") else boxes.groupBy("page").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY h)").alias("glyph_h")), "page")


def reading_order(boxes: DataFrame, band: float = 16.0) -> DataFrame:
    """``rank`` of each box: rows of ``band`` pixels from the top, then from the left. A total order, unlike a tolerance comparator."""
    return boxes.withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy(F.floor(F.col("y") / band), "x", "y", "no")))


def top_regions(boxes: DataFrame, k: int = 4, min_w: float = 8.0, min_h: float = 6.0) -> DataFrame:
    """The ``k`` largest usable boxes of a page."""
    ranked = boxes.where((F.col("w") >= min_w) & (F.col("h") >= min_h)).withColumn("rank", F.row_number().over(Window.partitionBy("page").orderBy((F.col("w") * F.col("h")).desc(), "no")))
    return ranked.where(F.col("rank") <= k)


def _part(x: Column) -> G.Box:
    return G.Box(x["x"], x["y"], x["w"], x["h"])


def _fold(boxes: DataFrame, order: tuple, merge, keys: tuple[str, ...] = ITEM) -> DataFrame:
    """A page's items, in ``order``, folded into the list that stays; one row for each kept item with its position."""
    item = F.struct(*[F.col(c) for c in keys])
    listed = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], item.alias("item")))).alias("l"))
    kind = f"array<{boxes.select(item.alias('i')).schema['i'].dataType.simpleString()}>"
    kept = F.aggregate(F.transform("l", lambda s: s["item"]), F.array().cast(kind), merge)
    return listed.select("page", F.posexplode(kept).alias("pos", "item")).select("page", "pos", "item.*")


def _same_spot(a: Column, b: Column, strong: float, weak: float) -> Column:
    ratio = G.overlap_ratio(_part(a), _part(b))
    (ax, ay), (bx, by) = G.centre(_part(a)), G.centre(_part(b))
    near = (F.abs(ax - bx) < F.greatest(a["w"], b["w"]) * 0.35) & (F.abs(ay - by) < F.greatest(a["h"], b["h"]) * 0.5)
    return (ratio > strong) | ((ratio > weak) & near)


def dedupe_overlapping(items: DataFrame, strong: float = 0.55, weak: float = 0.3) -> DataFrame:
    """First-fit de-duplication in input order; the better of two takes the place of the first."""

    def merge(kept: Column, a: Column) -> Column:
        at = F.coalesce(F.array_position(F.transform(kept, lambda b: _same_spot(a, b, strong, weak)), True), F.lit(0))

        def settle(b: Column, i: Column) -> Column:
            said, had = F.coalesce(a["dst"], F.lit("")) != "", F.coalesce(b["dst"], F.lit("")) != ""
            better = (said & ~had) | ((said == had) & (a["w"] * a["h"] > b["w"] * b["h"]))
            return F.when((i + 1 == at) & better, a).otherwise(b)

        return F.when(at == 0, F.array_append(kept, a)).otherwise(F.transform(kept, settle))

    return _fold(items, (F.col("no"),), merge)


def collapse_overlapping(items: DataFrame, least: float = 0.42) -> DataFrame:
    """Longest text first, smaller box first; a box over an already kept one is dropped. Output keeps that order."""
    shown = F.when(F.coalesce(F.col("dst"), F.lit("")) != "", F.col("dst")).otherwise(F.coalesce(F.col("src"), F.lit("")))

    def merge(kept: Column, a: Column) -> Column:
        hit = F.exists(kept, lambda b: G.overlap_ratio(_part(a), _part(b)) > least)
        return F.when(hit, kept).otherwise(F.array_append(kept, a))

    return _fold(items, (-F.length(shown), F.col("w") * F.col("h"), F.col("no")), merge)


def dedupe_same_text(items: DataFrame, overlap: float = 0.5, threshold: float = 0.82, first: Column | None = None) -> DataFrame:
    """Of boxes that overlap and say the same, the first stays: ``first`` (say, a source rank), reading order, larger area, input."""

    def merge(kept: Column, a: Column) -> Column:
        hit = F.exists(kept, lambda b: (G.overlap_ratio(_part(a), _part(b)) > overlap) & T.same_norm(a["_norm"], b["_norm"], threshold))
        return F.when(hit, kept).otherwise(F.array_append(kept, a))

    order = (first if first is not None else F.lit(0), F.floor(F.col("y") / 16), F.col("x"), -(F.col("w") * F.col("h")), F.col("no"))
    sized = items.where((F.col("w") > 0) & (F.col("h") > 0)).withColumn("_norm", T.norm_text(F.col("src")))
    return _fold(sized, order, merge, (*ITEM, "_norm")).drop("_norm")


def _hull(a: dict, b: dict) -> dict:
    x, y = min(a["x"], b["x"]), min(a["y"], b["y"])
    return {"x": x, "y": y, "w": max(a["x"] + a["w"], b["x"] + b["w"]) - x, "h": max(a["y"] + a["h"], b["y"] + b["h"]) - y}


def _wide(c: str) -> bool:
    return c.isspace() or any(lo <= c <= hi for lo, hi in (("　", "ヿ"), ("㐀", "䶿"), ("一", "鿿"), ("＀", "￯")))


def joined_dst(a: str, b: str) -> str:
    return a + b if not a or not b or _wide(a[-1]) or _wide(b[0]) else f"{a} {b}"


def merge_line(rows: list[dict], min_overlap_y: float = 0.55, max_height_ratio: float = 1.8, gap_ratio: float = 1.2, min_gap_ratio: float = -0.35, most: int = 8) -> list[dict]:
    """Merge fragments of a line, at most ``most`` merges: top-left order, always the first pair that fits."""
    rows = sorted((dict(r, merged=r.get("merged", 0)) for r in rows), key=lambda r: (r["y"], r["x"]))

    def fits(a: dict, b: dict) -> bool:
        low, high = sorted((a["h"], b["h"]))
        over = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
        gap = max(a["x"], b["x"]) - min(a["x"] + a["w"], b["x"] + b["w"])
        return low > 0 and over >= min_overlap_y * low and high <= max_height_ratio * low and min_gap_ratio * high <= gap <= gap_ratio * high

    for _ in range(most):
        hit = next(((i, j) for i in range(len(rows)) for j in range(i + 1, len(rows)) if fits(rows[i], rows[j])), None)
        if hit is None:
            break
        i, j = hit
        a, b = sorted((rows[i], rows[j]), key=lambda r: r["x"])
        src = " ".join(s for s in ((a["src"] or "").strip(), (b["src"] or "").strip()) if s)
        rows[i] = {**rows[i], **_hull(a, b), "src": src, "dst": joined_dst(a["dst"] or "", b["dst"] or ""), "merged": rows[i]["merged"] + rows[j]["merged"] + 1}
        del rows[j]
        rows.sort(key=lambda r: (r["y"], r["x"]))
    return rows


def merge_adjacent(items: DataFrame, **options) -> DataFrame:
    schema = "page long, no int, x double, y double, w double, h double, src string, dst string, merged int"
    return per_page(items, ITEM, ("no",), lambda rows: merge_line(rows, **options), schema)


def block_of(rows: list[dict], v_gap: float = 14.0, h_gap: float = 40.0, align: float = 0.35) -> list[list[int]]:
    """Clusters of boxes (indices): a seed's hull takes in whatever joins it on its row or below it, until nothing does."""
    left = sorted((i for i, r in enumerate(rows) if r["w"] > 0 and r["h"] > 0), key=lambda i: (rows[i]["y"], rows[i]["x"]))
    out = []
    while left:
        hull, mine = rows[left[0]], [left.pop(0)]
        grown = True
        while grown:
            grown = False
            for i in list(left):
                b = rows[i]
                line = max(1.0, min(hull["h"], b["h"]))
                over_x = min(hull["x"] + hull["w"], b["x"] + b["w"]) - max(hull["x"], b["x"])
                over_y = min(hull["y"] + hull["h"], b["y"] + b["h"]) - max(hull["y"], b["y"])
                row = over_y > 0.5 * line and -over_x <= h_gap
                column = over_x > -align * line and -over_y <= v_gap and abs(b["x"] - hull["x"]) < max(align * line * 4, 60)
                if row or column:
                    hull, grown = _hull(hull, b), True
                    mine.append(i)
                    left.remove(i)
        out.append(mine)
    return out


def group_blocks(boxes: DataFrame, **options) -> DataFrame:
    """Blocks of a page: hull and number of members."""

    def work(rows: list[dict]) -> list[dict]:
        out = []
        for n, members in enumerate(block_of(rows, **options)):
            hull = rows[members[0]]
            for i in members:
                hull = _hull(hull, rows[i])
            out.append({"block": n, **{c: hull[c] for c in "xywh"}, "members": len(members)})
        return out

    return per_page(boxes, ("no", "x", "y", "w", "h"), ("no",), work, "page long, block int, x double, y double, w double, h double, members int")


def _ratio(a: dict, b: dict) -> float:
    least = min(max(a["w"], 0) * max(a["h"], 0), max(b["w"], 0) * max(b["h"], 0))
    over_x = min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"])
    over_y = min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"])
    return over_x * over_y / least if least > 0 and over_x > 0 and over_y > 0 else 0.0


def _near(a: dict, b: dict) -> bool:
    return abs(a["x"] + a["w"] / 2 - (b["x"] + b["w"] / 2)) < max(a["w"], b["w"]) * 0.35 and abs(a["y"] + a["h"] / 2 - (b["y"] + b["h"] / 2)) < max(a["h"], b["h"]) * 0.5


def _in_order(rows: list[dict], *first) -> list[dict]:
    """Rows by the functions ``first``, then by all columns of an item, nulls first."""
    return sorted(rows, key=lambda r: (*[f(r) for f in first], *[(r[c] is not None, r[c]) for c in ITEM]))


def first_fit(rows: list[dict], strong: float = 0.55, weak: float = 0.3) -> list[dict]:
    """``dedupe_overlapping`` of one page's rows."""
    kept: list[dict] = []
    for a in _in_order(rows):
        for i, b in enumerate(kept):
            ratio = _ratio(a, b)
            if ratio > strong or (ratio > weak and _near(a, b)):
                said, had = bool(a["dst"]), bool(b["dst"])
                if (said and not had) or (said == had and a["w"] * a["h"] > b["w"] * b["h"]):
                    kept[i] = a
                break
        else:
            kept.append(a)
    return kept


def collapsed(rows: list[dict], least: float = 0.42) -> list[dict]:
    """``collapse_overlapping`` of one page's rows."""
    kept: list[dict] = []
    for a in _in_order(rows, lambda r: -len(r["dst"] or r["src"] or ""), lambda r: r["w"] * r["h"]):
        if not any(_ratio(a, b) > least for b in kept):
            kept.append(a)
    return kept


def prepare_items(items: DataFrame, mode: str = "smart") -> DataFrame:
    """De-duplicate, merge fragments (``whole``: across any gap; ``off``: not at all), de-duplicate, collapse: a page's rows are moved once for all of it."""
    if mode == "off":
        return dedupe_overlapping(items).drop("pos")
    options = {"gap_ratio": float("inf")} if mode == "whole" else {}
    schema = "page long, no int, x double, y double, w double, h double, src string, dst string"
    return per_page(items, ITEM, ("no",), lambda rows: collapsed(first_fit(merge_line(first_fit(rows), **options))), schema)


def drop_repeats(boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """Boxes found twice by overlapping tiles: of those that overlap by more than ``least``, the first stays."""

    def merge(kept: Column, a: Column) -> Column:
        return F.when(F.exists(kept, lambda b: G.overlap_ratio(_part(a), _part(b)) > least), kept).otherwise(F.array_append(kept, a))

    return _fold(boxes, (F.col("no"),), merge, ("no", "x", "y", "w", "h"))


def drop_reread(lines: DataFrame, overlap: float = 0.5, more: tuple[str, ...] = ()) -> DataFrame:
    """Lines that neighbouring bands both read (page, no, x, y, w, h, text, conf, and the columns ``more``): the surer one takes the first one's place."""

    def merge(kept: Column, a: Column) -> Column:
        again = lambda b: (G.overlap_ratio(_part(b), _part(a)) > overlap) & T.same_norm(b["_norm"], a["_norm"])
        at = F.coalesce(F.array_position(F.transform(kept, again), True), F.lit(0))
        surer = lambda b: F.coalesce(a["conf"], F.lit(0.0)) > F.coalesce(b["conf"], F.lit(0.0))
        return F.when(at == 0, F.array_append(kept, a)).otherwise(F.transform(kept, lambda b, i: F.when((i + 1 == at) & surer(b), a).otherwise(b)))

    normed = lines.withColumn("_norm", T.norm_text(F.col("text")))
    return _fold(normed, (F.col("no"),), merge, ("no", "x", "y", "w", "h", "text", "conf", *more, "_norm")).drop("_norm")


def regions_of(rows: list[dict], most: int = 40, v_gap: int = 14, h_gap: int = 40) -> list[dict]:
    """Regions of lines; while there are too many, gaps widen (four tries), and only then the best ``most`` stay."""
    for _ in range(4):
        blocks = block_of(rows, v_gap, h_gap)
        if len(blocks) <= most:
            break
        v_gap, h_gap = int(v_gap * 1.8 + 0.5), int(h_gap * 1.8 + 0.5)
    out = []
    for members in blocks:
        hull = rows[members[0]]
        for i in members:
            hull = _hull(hull, rows[i])
        w, h, ink = max(1.0, hull["w"]), max(1.0, hull["h"]), sum(rows[i].get("ink") or 0 for i in members)
        even = 1.0 if 0.06 <= ink / (w * h) <= 0.62 else 0.35
        out.append({"x": hull["x"], "y": hull["y"], "w": w, "h": h, "ink": int(ink), "lines": len(members), "score": min(1.0, 0.5 * even + 0.12 * min(len(members), 6))})
    out = sorted(sorted(out, key=lambda r: (-r["score"], -r["ink"]))[:most], key=lambda r: (r["y"] // 16, r["x"]))
    return [{"region": i, **r} for i, r in enumerate(out)]


def group_regions(lines: DataFrame, **options) -> DataFrame:
    """Regions of the lines (page, no, x, y, w, h, ink) of each page, in reading order."""
    schema = "page long, region int, x double, y double, w double, h double, ink long, lines int, score double"
    return per_page(lines, ("no", "x", "y", "w", "h", "ink"), ("no",), lambda rows: regions_of(rows, **options), schema)
