"""Recognition from end to end: tiles to lines and regions, bands to an outside reader, and its answers to lines of the page."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as T
from . import boxes as B
from . import kernels as K
from . import ocr as O
from .pages import in_slices, kept, tasks

#: The longest side at which a page is searched in one piece; sides and zoom of a page that is read whole.
WHOLE_SIDE, READ_SIDE = 1600.0, 1800.0
FOUND = "page long, tile int, kind string, no int, x double, y double, w double, h double, ink long, lines int, score double"


def cut_tiles(pages: DataFrame, most: float = WHOLE_SIDE) -> DataFrame:
    """Pages (page, width, height, lum binary) as overlapping tiles (page, tile, x, y, width, height, lum); a small page is one tile.

    A tile is a row of its own from here on, so a large scan is many tasks.
    """
    wide, high = F.col("width").cast("double"), F.col("height").cast("double")
    planned = pages.select("page", "width", "height", "lum", G.tiles(wide, high, most).alias("tiles"))

    def work(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for r in b.itertuples(index=False):
            plane = np.frombuffer(r.lum, dtype=np.uint8).reshape(r.height, r.width)
            for i, t in enumerate(r.tiles):
                x, y, w, h = (int(t[k]) for k in "xywh")
                rows.append((r.page, i, x, y, w, h, plane[y : y + h, x : x + w].tobytes()))
        return pd.DataFrame(rows, columns=["page", "tile", "x", "y", "width", "height", "lum"])

    return in_slices(planned, "lum", work, "page long, tile int, x int, y int, width int, height int, lum binary")


def detect_tiled(pages: DataFrame, most: float = WHOLE_SIDE) -> DataFrame:
    """Lines and regions (``kind``) of pages, found tile by tile, moved to the page, without repeats, numbered in reading order.

    Lines of two tiles that overlap by more than half are one, regions from 0.4 on; the first tile's stays.
    """
    names = [c.split()[0] for c in FOUND.split(", ")]

    def work(b: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for t in b.itertuples(index=False):
            lines = K.detect(np.frombuffer(t.lum, dtype=np.uint8).reshape(t.height, t.width))
            found = [("line", {**line, "lines": 1, "score": None}) for line in lines] + [("region", g) for g in B.regions_of(lines)]
            for no, (kind, r) in enumerate(found):
                rows.append((t.page, t.tile, kind, no, float(r["x"] + t.x), float(r["y"] + t.y), float(r["w"]), float(r["h"]), int(r["ink"]), r["lines"], r["score"]))
        return pd.DataFrame(rows, columns=names)

    tiles = cut_tiles(pages, most).repartition(tasks(pages.sparkSession), "page", "tile")
    found = kept(in_slices(tiles, "lum", work, FOUND))
    number = (F.col("tile").cast("long") * (1 << 31) + F.col("no")).alias("no")
    parts = []
    for kind, least in (("line", 0.5), ("region", 0.4)):
        mine = found.where(F.col("kind") == kind)
        once = B.drop_repeats(mine.select("page", number, "x", "y", "w", "h"), least)
        whole = once.select("page", "no").join(mine.withColumn("no", number), ["page", "no"])
        parts.append(B.reading_order(whole).select("page", F.lit(kind).alias("kind"), F.col("rank").alias("no"), "x", "y", "w", "h", "ink", "lines", "score"))
    return parts[0].unionByName(parts[1])


def reading_bands(pages: DataFrame, lines: DataFrame) -> DataFrame:
    """Bands (page, band, x, y, w, h, zoom) of each page; a page (page, width, height) without lines is read whole, once, up to twice as large."""
    bands = O.plan_bands(lines).select("page", "band", "x", "y", "w", "h", "zoom")
    bare = pages.select("page", "width", "height").join(lines.select("page").distinct(), "page", "left_anti")
    zoom = F.least(F.lit(2.0), F.greatest(F.lit(1.0), READ_SIDE / F.greatest("width", "height", F.lit(1))))
    whole = bare.select("page", F.lit(0).alias("band"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("width").cast("double").alias("w"), F.col("height").cast("double").alias("h"), zoom.alias("zoom"))
    return bands.unionByName(whole)


def recognise(pages: DataFrame, lines: DataFrame, reader: Callable[[list[dict]], list[dict | None]]) -> tuple[DataFrame, DataFrame]:
    """The page's text lines (page, no, x, y, w, h, text, conf, font_height) and a report (page, bands, calls, raw, kept).

    ``reader`` is any function from bands (dicts of page, band, x, y, w, h, zoom) to answers of the same number: None for a failure, else a dict
    with ``tsv`` and, if it has one, ``tree`` (JSON), in pixels of the zoomed band. Its answers are checkpointed; as a lost task
    may ask again, it should be idempotent. A band's words come from its TSV; if that has lines and none is usable, from its tree. Usable lines are moved
    to the page, and what neighbouring bands both read is kept once, the surer of the two.
    """
    asked = ("page", "band", "x", "y", "w", "h", "zoom")
    schema = "page long, band int, x double, y double, w double, h double, zoom double, answered boolean, tsv string, tree string"

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            said = reader(b[list(asked)].to_dict("records"))
            said = [s if s is not None else {} for s in said]
            yield b.assign(answered=[bool(s) for s in said], tsv=[s.get("tsv") for s in said], tree=[s.get("tree") for s in said])

    spark = pages.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    answers = kept(reading_bands(pages, lines).repartition(n, "page", "band").mapInPandas(ask, schema))
    at = ("bx", "by", "zoom")
    placed = answers.select("page", "band", F.col("x").alias("bx"), F.col("y").alias("by"), "zoom", "tsv", "tree")
    rows = placed.select("page", "band", *at, F.explode(F.split(F.coalesce("tsv", F.lit("")), "\r?\n")).alias("line"))
    words = O.tsv_lines(O.parse_tsv(rows), ("page", "band", *at)).select("page", "band", *at, "text", "conf", *[F.col(c).cast("double").alias(c) for c in "xywh"])
    flat = kept(words.withColumn("noise", T.looks_like_noise(F.col("text"), F.col("conf"))))  # read three times, made once
    good = flat.where("NOT noise").withColumn("font_height", F.col("h"))
    left = flat.groupBy("page", "band").agg(F.every(F.coalesce("noise", F.lit(True))).alias("none")).where("none")
    trees = placed.join(left, ["page", "band"], "left_semi").where("tree IS NOT NULL").select("page", "band", *at, F.col("tree").alias("body"))
    other = O.usable_lines(O.lines_of_tree(trees))
    columns = ("page", "band", *at, "text", "conf", "x", "y", "w", "h", "font_height")
    read = good.select(*columns).unionByName(other.select(*columns))
    moved = read.select(
        "page", "band", "text", F.col("conf").cast("double").alias("conf"), *[(F.col(f"b{c}") + F.col(c) / F.col("zoom")).alias(c) for c in "xy"],
        *[(F.col(c) / F.col("zoom")).alias(c) for c in ("w", "h", "font_height")],
    )
    order = F.struct("band", "y", "x", "text", "w")
    listed = moved.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "y", "x", "w", "h", "text", "conf", "font_height"))).alias("l"))
    numbered = kept(listed.select("page", F.posexplode("l").alias("no", "r")).select("page", "no", "r.x", "r.y", "r.w", "r.h", "r.text", "r.conf", "r.font_height"))
    once = B.drop_reread(numbered, more=("font_height",)).drop("pos")
    per = answers.groupBy("page").agg(F.count("*").alias("bands"), F.count_if("answered").alias("calls"))
    report = per.join(flat.groupBy("page").agg(F.count("*").alias("raw")), "page", "left").join(once.groupBy("page").agg(F.count("*").alias("kept")), "page", "left")
    return once, report.na.fill(0, ["raw", "kept"])
