"""Pages from image files, glossaries from text files, and pages back to image files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_kind
from ..operators.glossary import parse_glossary
from ..operators.kernels import resize


def listed(spark: SparkSession, path: str) -> DataFrame:
    """Files under ``path`` with their kind (pdf or image); others are left out. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    return files.withColumn("kind", file_kind(F.col("path"), F.lit(""))).where("kind IS NOT NULL")


def accepted(files: DataFrame) -> DataFrame:
    """The files of a job, PDFs first. At least one file and at most one PDF, or an error at action time."""
    n = files.agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "pdf").alias("pdfs"))
    fault = F.when(F.col("n") == 0, "no file to work on").when(F.col("pdfs") > 1, "more than one PDF")
    return files.crossJoin(F.broadcast(n)).where(F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(True)).drop("n", "pdfs").orderBy(F.col("kind") != "pdf", "path")


def _rgb(data: bytes, width: int, height: int, channels: int) -> np.ndarray:
    """Red, green and blue of what the image source gives: gray, blue-green-red, or that with an alpha, which is laid on white."""
    raw = np.frombuffer(data, dtype=np.uint8).reshape(height, width, channels)
    if channels == 1:
        return np.repeat(raw, 3, axis=2)
    colour = raw[..., 2::-1]
    if channels == 3:
        return colour
    alpha = raw[..., 3:].astype(np.float64) / 255
    return np.rint(colour * alpha + 255 * (1 - alpha)).astype(np.uint8)


def image_pages(spark: SparkSession, path: str, fitted: bool = False) -> DataFrame:
    """Images as pages of RGB bytes (page, origin, width, height, rgb): gray, coloured and transparent ones; broken files are dropped.

    With ``fitted`` each comes at the size at which it is read (``target_size``).
    """
    image = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")
    size = target_size(F.col("width").cast("double"), F.col("height").cast("double"))
    image = image.select(F.xxhash64("origin").alias("page"), "origin", "width", "height", "nChannels", "data", *[size[k].cast("int").alias(f"to_{k}") for k in ("width", "height")])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                rgb, w, h = _rgb(r.data, r.width, r.height, r.nChannels), r.width, r.height
                if fitted and (r.to_width, r.to_height) != (w, h):
                    rgb, w, h = resize(rgb, r.to_width, r.to_height), r.to_width, r.to_height
                yield pd.DataFrame({"page": [r.page], "origin": [r.origin], "width": [w], "height": [h], "rgb": [rgb.tobytes()]})

    return image.mapInPandas(run, "page long, origin string, width int, height int, rgb binary")


def target_size(width, height, longest: float = 3800.0, small: float = 900.0, wanted: float = 1600.0) -> dict:
    """Scale at which an image is read: small ones up (twice at most), large ones down."""
    side = F.greatest(width, height)
    scale = F.when(side < small, F.least(F.lit(2.0), wanted / side)).when(side > longest, longest / side).otherwise(F.lit(1.0))
    return {"scale": scale, "width": F.floor(width * scale + 0.5), "height": F.floor(height * scale + 0.5)}


def glossary_file(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a glossary file, numbered by line."""
    whole = spark.read.text(path, wholetext=True)
    return parse_glossary(whole.select(F.posexplode(F.split("value", "\r?\n")).alias("no", "line")))
