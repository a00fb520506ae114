"""Queries that print pages to PDF files and read these back: text layers, lines and images."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import ocr as O
from ..operators.pages import kept, shared_dir
from ..sources import derive as D
from ..sources import pdf as P
from .oracles import MORE
from .queries import PAGE_W, SQL, _plane_rows, query

#: Pages of one book; a book's pages are numbered without gaps.
BOOK = 64
_NUMBERED = f"numbered AS (SELECT page // {BOOK} AS book, row_number() OVER (PARTITION BY page // {BOOK} ORDER BY page) AS page_no, page FROM (SELECT DISTINCT page FROM source))"


def _through_files(spark, pages, read, **options):
    """``pages`` printed to files in the shared folder and read back; the files are deleted once what was read is kept."""
    folder = f"{shared_dir(spark)}/pdf-{uuid.uuid4().hex}"
    found = kept(read(spark, folder, P.write_pdfs(pages, folder, **options)))
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return found.where(F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("boolean")).otherwise(True)).withColumn("book", F.regexp_extract("path", r"(\d+)\.pdf$", 1).cast("long"))


def _books(pages):
    book = F.floor(F.col("page") / BOOK)
    order = Window.partitionBy(book).orderBy("page")  # at most BOOK rows
    return pages.withColumn("doc", book).withColumn("page_no", F.row_number().over(order))


def _layers(spark, sf_dir):
    """Orders as pages whose boxes are text; two in three are stretched to their box."""
    piece = F.struct("no", "x", "y", F.col("h").alias("size"), F.when(F.col("no") % 3 != 0, F.col("w")).alias("width"), F.col("src").alias("text"))
    pages = D.boxes(spark, sf_dir).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(piece)), lambda i: i.dropFields("no")).alias("items"))
    pages = pages.withColumns({"width_pt": F.lit(float(PAGE_W)) + F.col("page") % 7, "height_pt": F.lit(600.0), "width": F.lit(None), "height": F.lit(None), "rgb": F.lit(None).cast("binary")})
    return _through_files(spark, _books(pages), P.read_pdfs)


@query(f"""WITH {D.BOXES}, source AS (SELECT page FROM boxes), {_NUMBERED}, a AS (SELECT *, CASE WHEN no % 3 <> 0 THEN w ELSE greatest(h * 0.5, length(src) * h * 0.5) END AS adv FROM boxes)
SELECT book, page_no, CAST({PAGE_W} + page % 7 AS DOUBLE) AS width_pt, CAST(600 AS DOUBLE) AS height_pt, CAST(no AS INTEGER) AS no, round(x, 6) AS x, round(y - 0.85 * h, 6) AS y, round(adv, 6) AS w, round(1.15 * h, 6) AS h, h AS font_height, y AS base_y, src AS raw
FROM a JOIN numbered USING (page)""")
def pdf_text_layer(spark, sf_dir):
    """Every piece of text that was printed, read from the files with its box and its page's size."""
    found = P.text_layer(_layers(spark, sf_dir))
    return found.select("book", F.col("page_no").cast("long").alias("page_no"), "width_pt", "height_pt", "no", *[F.round(c, 6).alias(c) for c in "xywh"], "font_height", "base_y", "raw")


@query()
def pdf_page_lines(spark, sf_dir):
    """Lines of the text layers of printed pages."""
    found = P.text_layer(_layers(spark, sf_dir)).withColumn("page", F.col("book") * BOOK + F.col("page_no") - 1)
    lines = O.group_text_items(found)
    return lines.withColumn("book", F.floor(F.col("page") / BOOK)).withColumn("page_no", F.col("page") % BOOK + 1).drop("page")


MORE["pdf_page_lines"] = f"""WITH lines AS ({MORE["pdf_group_items"]}), source AS (SELECT DISTINCT l_orderkey AS page FROM lineitem), {_NUMBERED}
SELECT book, page_no, x, y, w, h, font_height, text, parts FROM lines JOIN numbered USING (page)"""


@query(f"""WITH {D.PLANES}, source AS (SELECT page FROM planes), {_NUMBERED}, rows AS (SELECT page, y, string_agg(repeat(printf('%02x', lum), 24), '' ORDER BY x) AS line FROM planes GROUP BY page, y),
body AS (SELECT page, string_agg(repeat(line, 8), '' ORDER BY y) AS pixels FROM rows GROUP BY page)
SELECT book, page_no, CAST(25.6 AS DOUBLE) AS width_pt, CAST(25.6 AS DOUBLE) AS height_pt, sha256(unhex(pixels)) AS digest FROM body JOIN numbered USING (page)""")
def pdf_image_pages(spark, sf_dir):
    """Page images printed at 180 dpi: page sizes and pixels as they are read from the files."""
    pages = _plane_rows(spark, sf_dir).select("page", "width", "height", F.unhex(F.regexp_replace(F.hex("lum"), "(..)", "$1$1$1")).alias("rgb"), F.lit(None).alias("width_pt"), F.lit(None).alias("height_pt"), F.lit(None).alias("items"))
    read = lambda spark, folder, files: P.read_pdf_images(spark, folder, files).join(P.read_pdfs(spark, folder, files).select("path", "page_no", "width_pt", "height_pt"), ["path", "page_no"])
    found = _through_files(spark, _books(pages), read, scale=2.5)
    return found.select("book", F.col("page_no").cast("long").alias("page_no"), F.round("width_pt", 6).alias("width_pt"), F.round("height_pt", 6).alias("height_pt"), F.sha2("rgb", 256).alias("digest"))
