"""Reading pages with an outside reader: region crops and the whole page are asked, replies become items, failures are rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import geometry as G
from ..functions import semijson as J
from . import boxes as B
from .pages import kept, lists

#: ``reader(image, crop, kind)``: the page's image, the crop as a dict (x, y, w, h, scale), and "region" or "whole"; returns the reply's text.
Reader = Callable[[bytes, dict, str], str]


def requests(pages: DataFrame, regions: DataFrame, most: int = 24, whole: bool = True, whole_side: float = 1800.0) -> DataFrame:
    """The crops to ask for of each page (page, width, height): its ``most`` largest regions, then the whole page."""
    size = pages.select("page", F.col("width").cast("double").alias("pw"), F.col("height").cast("double").alias("ph"))
    crop = G.crop_for_region(G.Box.of(), F.col("pw"), F.col("ph"))
    top = B.top_regions(regions.select("page", "no", "x", "y", "w", "h"), most).join(size, "page")
    out = top.select("page", "pw", "ph", F.lit("region").alias("kind"), F.col("rank").cast("int").alias("no"), *[crop[c].alias(c) for c in ("x", "y", "w", "h", "scale")])
    if not whole:
        return out
    zoom = F.least(F.lit(1.0), whole_side / F.greatest("pw", "ph"))
    return out.unionByName(size.select("page", "pw", "ph", F.lit("whole").alias("kind"), F.lit(1 << 30).alias("no"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.col("pw").alias("w"), F.col("ph").alias("h"), zoom.alias("scale")))


def ask(pages: DataFrame, wanted: DataFrame, reader: Reader, image: str = "image") -> DataFrame:
    """``wanted`` with ``reply`` and ``error``; a failed request fails alone. Each image is moved once, to all its crops.

    The answers are checkpointed, so that nothing later asks again; after a lost task the reader may be asked twice.
    """
    names = ("kind", "no", "pw", "ph", "x", "y", "w", "h", "scale")
    listed = wanted.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("no", *[c for c in names if c != "no"]))).alias("crops"))

    schema = "page long, kind string, no int, pw double, ph double, x double, y double, w double, h double, scale double, reply string, error string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    place = ("x", "y", "w", "h", "scale")

    def one(data: bytes, crop: dict, kind: str) -> tuple[str | None, str | None]:
        try:
            reply = reader(data, crop, kind)
            return (None, "PARSE_FAILED") if reply and reply.strip() and J.extract(reply) is None else (reply, None)
        except Exception as e:  # any failure of an outside service is a row, never a lost page
            return None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, at, images = b["crops"].flatten(), pc.list_parent_indices(b["crops"]), b["image"].to_pylist()
            columns = dict(zip([f.name for f in flat.type], flat.flatten())) | {"page": b["page"].take(at)}
            crops = zip(*[lists(columns[c]) for c in place])
            said = [one(images[i], dict(zip(place, c)), kind) for i, c, kind in zip(at.to_pylist(), crops, lists(columns["kind"]))]
            columns |= {"reply": [s[0] for s in said], "error": [s[1] for s in said]}
            yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in names or f.name == "page" else pa.array(columns[f.name], f.type) for f in arrow], schema=arrow)

    joined = pages.select("page", F.col(image).alias("image")).join(listed, "page")
    return kept(joined.mapInArrow(run, schema))


def read_items(answers: DataFrame) -> DataFrame:
    """Items of all answers on their pages (page, pos, no, x, y, w, h, src, dst), said once; those of regions come before the whole page's.

    An item without a place stands at its crop's corner; items without text are left out.
    """
    said = J.parse_replies(answers.where("reply IS NOT NULL").select("page", "kind", F.col("no").alias("crop"), "pw", "ph", F.col("x").alias("cx"), F.col("y").alias("cy"), F.col("w").alias("cw"), F.col("h").alias("ch"), F.col("reply").alias("body")))
    said = said.withColumn("_box", G.normalise_1000([F.get("box", i) for i in range(4)]))  # used eight times, made once
    place = G.map_from_crop(F.col("_box"), F.col("cx"), F.col("cy"), F.col("cw"), F.col("ch"), F.col("pw"), F.col("ph"))
    items = said.select("page", (F.col("crop").cast("long") * 100_000 + F.col("item_no")).alias("no"), *[c.alias(n) for n, c in zip("xywh", place, strict=True)], "src", "dst")
    return B.dedupe_same_text(items, first=(F.col("no") >= (1 << 30) * 100_000).cast("int"))


def reading_report(answers: DataFrame, items: DataFrame) -> DataFrame:
    """One row for each page: requests, failures, items, and ``usable``.

    A page is not usable when all its regions failed, or when anything failed and nothing was read: an empty result would pass for an empty page.
    """
    bad = F.col("error").isNotNull()
    per = answers.groupBy("page").agg(F.count("*").alias("requests"), F.count_if(bad).alias("failed"), F.count_if(F.col("kind") == "region").alias("regions"), F.count_if(bad & (F.col("kind") == "region")).alias("_bad"), F.max_by("error", F.when(bad, F.col("no"))).alias("last_error"))
    out = per.join(items.groupBy("page").agg(F.count("*").alias("items")), "page", "left").withColumn("items", F.coalesce("items", F.lit(0)))
    lost = ((F.col("regions") > 0) & (F.col("_bad") >= F.col("regions"))) | ((F.col("failed") > 0) & (F.col("items") == 0))
    return out.withColumn("usable", ~lost).drop("_bad")
