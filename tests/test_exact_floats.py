"""Floats that must equal their SQL to the last bit, as rows of one page and text are told apart by them."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioflow.operators import ocr as O
from folioflow.plans import queries as plans

SF = "/root/testdata/sf0.001"


def test_glyph_box_extents_carry_no_noise_of_the_place(spark):
    """Upright, turned by a quarter, and mirrored: the box is the advance by 1.15 of the font, wherever it stands."""
    rows = [(f, x, y, a, b) for f in (10.0, 12.0, 14.0, 22.0) for x in (0.0, 470.0) for y in (12.0, 300.1) for a, b in ((1.0, 0.0), (0.0, 1.0), (-1.0, 0.0))]
    items = spark.createDataFrame(rows, "f double, x double, y double, a double, b double")
    view = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 600.0)])
    along = F.array(F.col("f") * F.col("a"), F.col("f") * F.col("b"), -F.col("f") * F.col("b"), F.col("f") * F.col("a"), F.col("x"), F.col("y"))
    box = O.glyph_box(view, along, F.lit(35.0), F.col("f"), F.lit("word"))
    for r in items.select("f", "a", box["w"].alias("w"), box["h"].alias("h")).collect():
        assert (r.w, r.h) == ((35.0, 1.15 * r.f) if r.a else (1.15 * r.f, 35.0))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_pdf_group_items_to_the_last_bit(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{SF}/lineitem.parquet'")
    names = ["page", "x", "y", "w", "h", "font_height", "text", "parts"]
    found = plans.QUERIES["pdf_group_items"](spark, SF).select(names).collect()
    assert sorted(map(tuple, found)) == sorted(con.sql(plans.SQL["pdf_group_items"]).select(*names).fetchall())
