"""Recognition output: tab-separated words to lines, bands of lines, and text-layer items to lines."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .pages import per_page

TSV = ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf", "text")


def parse_tsv(rows: DataFrame, line: str = "line") -> DataFrame:
    """TSV lines (any key columns pass through) as typed columns; rows without all fields are dropped."""
    parts = F.split(F.col(line), "\t")
    typed = [F.try_element_at(parts, F.lit(i + 1)).alias(c) for i, c in enumerate(TSV)]
    rest = [F.col(c) for c in rows.columns if c != line]
    t = rows.where(F.size(parts) >= len(TSV)).select(*rest, *typed)
    return t.select(*rest, *[F.expr(f"try_cast({c} AS {'double' if c == 'conf' else 'int'})").alias(c) if c != "text" else F.col(c) for c in TSV]).where("level is not null")


def tsv_lines(words: DataFrame, key: tuple[str, ...] = ()) -> DataFrame:
    """Lines of words (level 5): text in word order, mean confidence of words that have one, hull of their boxes."""
    by = [*key, "page_num", "block_num", "par_num", "line_num"]
    w = words.where((F.col("level") == 5) & (F.trim("text") != ""))
    out = w.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("word_num", "text"))).alias("w"), F.avg(F.when(F.col("conf") >= 0, F.col("conf"))).alias("conf"),
        F.min("left").alias("x"), F.min("top").alias("y"), F.max(F.col("left") + F.col("width")).alias("x1"), F.max(F.col("top") + F.col("height")).alias("y1"),
    )
    return out.select(*by, F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), "conf", "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def usable_lines(lines: DataFrame) -> DataFrame:
    return lines.where(~T.looks_like_noise(F.col("text"), F.col("conf"))).withColumn("font_height", F.col("h"))


def bands_of(rows: list[dict], most: int = 10, lines: int = 12, side: float = 2600.0) -> list[dict]:
    """Bands of lines like in height and near each other, each with the zoom at which it is read."""
    rows = sorted(rows, key=lambda r: (r["y"], r["x"]))
    if not rows:
        return []
    bands: list[list[dict]] = []
    for r in rows:
        last = bands[-1] if bands else None
        if last:
            med = sorted(x["h"] for x in last)[len(last) // 2]
            if abs(r["h"] - med) <= max(3, 0.5 * med) and r["y"] - max(x["y"] + x["h"] for x in last) <= max(10, 2.5 * med) and len(last) < lines:
                last.append(r)
                continue
        bands.append([r])
    gap = lambda i: min(x["y"] for x in bands[i + 1]) - max(x["y"] + x["h"] for x in bands[i])
    while len(bands) > most:
        i = min(range(len(bands) - 1), key=gap)
        bands[i : i + 2] = [bands[i] + bands[i + 1]]
    out = []
    for b in bands:
        x, y = min(r["x"] for r in b), min(r["y"] for r in b)
        w, h = max(r["x"] + r["w"] for r in b) - x, max(r["y"] + r["h"] for r in b) - y
        med = float(sorted(r["h"] for r in b)[len(b) // 2])
        zoom = min(4.0, max(1.0, 32 / med))
        out.append({"x": x, "y": y, "w": w, "h": h, "med_h": med, "zoom": min(zoom, max(1.0, side / max(w, h))), "lines": len(b)})
    return out


def plan_bands(lines: DataFrame, **options) -> DataFrame:
    schema = "page long, band int, x double, y double, w double, h double, med_h double, zoom double, lines int"
    return per_page(lines, ("x", "y", "w", "h"), ("y", "x"), lambda rows: [{"band": i, **b} for i, b in enumerate(bands_of(rows, **options))], schema)


def affine(a: Column, b: Column) -> Column:
    """Product of two 2 x 3 matrices given as arrays (a, b, c, d, e, f)."""
    return F.array(
        a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3],
        a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5],
    )


def glyph_box(viewport: Column, transform: Column, width: Column, height: Column, string: Column) -> dict[str, Column]:
    """Page box of a text-layer item: from its baseline along its writing direction, 0.85 of the font up and 0.3 down.

    Its width and height come from its own extents, not as differences of far larger coordinates.
    """
    m = affine(viewport, transform)
    up, along = F.hypot(m[2], m[3]), F.hypot(m[0], m[1])
    font = F.when(up > 0, up).when(F.abs(height) > 0, F.abs(height)).otherwise(10.0)
    advance = F.when(F.coalesce(width > 0, F.lit(False)), width).otherwise(F.greatest(font * 0.5, F.greatest(F.length(T.clean_pdf_text(string)), F.lit(1)) * font * 0.5))
    dx, dy = F.when(along > 0, m[0] / along).otherwise(1.0), F.when(along > 0, m[1] / along).otherwise(0.0)
    ux, uy = F.when(up > 0, m[2] / up).otherwise(0.0), F.when(up > 0, m[3] / up).otherwise(0.0)
    ends = lambda start, d, u: [s + u * k for s in (start, start + d * advance) for k in (font * 0.85, -font * 0.3)]
    xs, ys = ends(m[4], dx, ux), ends(m[5], dy, uy)
    wide = lambda d, u: F.abs(d * advance) + F.abs(u) * (font * 1.15)
    return {"x": F.least(*xs), "y": F.least(*ys), "w": wide(dx, ux), "h": wide(dy, uy), "font_height": font, "base_y": m[5] + dy * advance / 2, "raw": T.clean_pdf_text(string)}


def group_text_items(items: DataFrame) -> DataFrame:
    """Items of a text layer (page, x, y, w, h, font_height, base_y, raw) joined to lines along their baselines."""

    def work(rows: list[dict]) -> list[dict]:
        left = [r for r in rows if r["raw"]]
        out = []
        while left:
            line = [left.pop(0)]
            base, tall, x0, x1 = line[0]["base_y"], line[0]["font_height"], line[0]["x"], line[0]["x"] + line[0]["w"]
            grown = True
            while grown:
                grown = False
                for r in list(left):
                    fh = max(r["font_height"], tall)
                    if abs(r["base_y"] - base) <= max(3, 0.35 * fh) and r["x"] - x1 <= max(12, 1.2 * fh) and x0 - (r["x"] + r["w"]) <= max(8, fh):
                        line.append(r)
                        left.remove(r)
                        grown, tall, x0, x1 = True, fh, min(x0, r["x"]), max(x1, r["x"] + r["w"])
            line.sort(key=lambda r: r["x"])
            text = line[0]["raw"]
            for a, b in zip(line, line[1:]):
                spaced = b["x"] - (a["x"] + a["w"]) > max(1.2, 0.18 * min(a["font_height"], b["font_height"]))
                text += (" " if spaced else "") + b["raw"]
            x, y = min(r["x"] for r in line), min(r["y"] for r in line)
            out.append({"x": x, "y": y, "w": max(r["x"] + r["w"] for r in line) - x, "h": max(r["y"] + r["h"] for r in line) - y, "font_height": max(r["font_height"] for r in line), "text": " ".join(text.split()), "parts": len(line)})
        out.sort(key=lambda r: (math.floor(r["y"] / 3), r["x"]))
        return out

    return per_page(items, ("base_y", "x", "y", "w", "h", "font_height", "raw"), ("base_y", "x"), work, "page long, x double, y double, w double, h double, font_height double, text string, parts int")


_AT = "struct<x0:double,y0:double,x1:double,y1:double>"
#: A reader's result tree: lines alone, lines inside blocks, or only words.
TREE = f"struct<lines:array<struct<text:string,confidence:double,bbox:{_AT}>>,blocks:array<struct<paragraphs:array<struct<lines:array<struct<text:string,confidence:double,bbox:{_AT}>>>>>>,words:array<struct<text:string,confidence:double,bbox:{_AT}>>>"


def lines_of_tree(trees: DataFrame, body: str = "body") -> DataFrame:
    """Lines of reader results in JSON, with the other columns: flat lines, else lines of blocks, else words whose tops are near each other.

    Lines without area or text go, and an unstated confidence is 100.
    """
    rest = [c for c in trees.columns if c != body]
    t = trees.select(*rest, F.from_json(body, TREE).alias("t"))
    nested = F.flatten(F.flatten(F.transform("t.blocks", lambda b: F.transform(b["paragraphs"], lambda p: F.coalesce(p["lines"], F.array().cast(t.schema["t"].dataType["lines"].dataType))))))
    tidy = lambda s: F.trim(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", " "))
    line = lambda l: F.struct(l["bbox"]["x0"].alias("x"), l["bbox"]["y0"].alias("y"), (l["bbox"]["x1"] - l["bbox"]["x0"]).alias("w"), (l["bbox"]["y1"] - l["bbox"]["y0"]).alias("h"), tidy(l["text"]).alias("text"), F.coalesce(l["confidence"], F.lit(100.0)).alias("conf"))
    usable = lambda a: F.filter(F.transform(a, line), lambda l: (l["w"] > 0) & (l["h"] > 0) & (l["text"] != ""))

    def place(lines: Column, w: Column) -> Column:
        """Put a word, by its top, on the last line or on a new one."""
        b, last = w["bbox"], F.get(lines, F.size(lines) - 1)
        one = F.struct(b["x0"].alias("x"), b["y0"].alias("y"), b["x1"].alias("x1"), b["y1"].alias("y1"), F.coalesce(w["text"], F.lit("")).alias("text"), F.coalesce(w["confidence"], F.lit(100.0)).alias("conf"), F.lit(1).alias("n"))
        both = F.struct(F.least(last["x"], b["x0"]).alias("x"), last["y"].alias("y"), F.greatest(last["x1"], b["x1"]).alias("x1"), F.greatest(last["y1"], b["y1"]).alias("y1"), F.concat_ws(" ", last["text"], one["text"]).alias("text"), (last["conf"] + one["conf"]).alias("conf"), (last["n"] + 1).alias("n"))
        apart = (F.size(lines) == 0) | (F.abs(b["y0"] - last["y"]) > F.greatest(F.lit(4.0), (b["y1"] - b["y0"]) * 0.6))
        return F.when(apart, F.array_append(lines, one)).otherwise(F.array_append(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), both))

    placed = F.filter("t.words", lambda w: w["bbox"].isNotNull())
    ordered = F.transform(F.array_sort(F.transform(placed, lambda w, i: F.struct(w["bbox"]["y0"].alias("y"), i.alias("i"), w.alias("w")))), lambda s: s["w"])
    kind = "array<struct<x:double,y:double,x1:double,y1:double,text:string,conf:double,n:int>>"
    worded = F.transform(F.aggregate(ordered, F.array().cast(kind), place), lambda l: F.struct(l["x"].alias("x"), l["y"].alias("y"), (l["x1"] - l["x"]).alias("w"), (l["y1"] - l["y"]).alias("h"), tidy(l["text"]).alias("text"), (l["conf"] / l["n"]).alias("conf")))
    flat, deep = usable(F.col("t.lines")), usable(nested)
    out = F.when(F.size(flat) > 0, flat).when(F.size(deep) > 0, deep).otherwise(worded)
    return t.select(*rest, F.posexplode(out).alias("line_no", "l")).select(*rest, "line_no", "l.*")
