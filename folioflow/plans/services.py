"""Queries of calls to outside services: several at once in a task, and page images as they are sent."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import calls as C
from ..operators import jpeg as J
from ..sources import derive as D
from .queries import _plane_rows, query


def length_service(row: dict) -> str:
    """Says how long a line is, and is busy for some of them."""
    n = len(row["line"])
    if n % 7 == 3:
        raise ConnectionError(f"busy at {n}")
    return f"{n} from {row['lang']}"


@query(f"""WITH {D.LINES} SELECT doc_id, line_no, CASE WHEN length(line) % 7 <> 3 THEN length(line) || ' from ' || coalesce(lang, 'None') END AS answer,
  CASE WHEN length(line) % 7 = 3 THEN 'ConnectionError: busy at ' || length(line) END AS error FROM lines""")
def service_calls(spark, sf_dir):
    """Every line of the documents sent to a service, eight calls at once in a task; a failed call is a row with its error."""
    return C.called(D.text_lines(spark, sf_dir), ("line", "lang"), length_service, at_once=8).select("doc_id", "line_no", "answer", "error")


@query(f"""WITH {D.PLANES} SELECT DISTINCT page, CAST(64 AS INTEGER) AS width, CAST(64 AS INTEGER) AS height, true AS closed, true AS same FROM planes""")
def service_jpeg_bodies(spark, sf_dir):
    """Page images as requests: size and ends as their files state them, and the file as it comes out of the body."""
    rgb = F.unhex(F.regexp_replace(F.hex("lum"), "(..)", "$1$1$1"))
    made = J.jpeg_pages(_plane_rows(spark, sf_dir).select("page", "width", "height", rgb.alias("rgb")))
    text = F.hex("jpeg")
    sizes = F.regexp_extract(text, "FFC0001108(.{4})(.{4})03", 1), F.regexp_extract(text, "FFC0001108(.{4})(.{4})03", 2)
    height, width = (F.conv(s, 16, 10).cast("int") for s in sizes)
    sent = F.regexp_extract(F.get_json_object(J.request_body("openai", F.lit("read"), F.col("jpeg")), "$.messages[1].content[1].image_url.url"), "^data:image/jpeg;base64,(.*)$", 1)
    closed = text.startswith("FFD8") & text.endswith("FFD9")
    return made.select("page", width.alias("width"), height.alias("height"), closed.alias("closed"), (F.unbase64(sent) == F.col("jpeg")).alias("same"))
