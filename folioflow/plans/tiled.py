"""Queries over pages of real size, drawn from the lines of orders and held in tiles."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import tiles as P
from ..operators.pages import kept
from ..sources import derive as D
from .queries import query

#: A supplier is a page of this size, and its lines are filled boxes on it.
WIDTH, HEIGHT = 1000, 760


def _marks(spark, sf_dir):
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return D.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("page"), F.row_number().over(order).cast("long").alias("no"),
        ((F.col("l_partkey") * 37 + F.col("l_orderkey") * 11) % 985).cast("int").alias("x"), ((F.col("l_orderkey") * 13 + F.col("l_linenumber") * 101) % 740).cast("int").alias("y"),
        (F.floor(F.col("l_quantity") / 5) + 2).cast("int").alias("w"), (F.col("l_linenumber") + 2).alias("h"), (F.col("l_linenumber") * 25 + 15).alias("shade"),
    )


_MARKS = """marks AS (SELECT l_suppkey AS page, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS no,
  CAST((l_partkey * 37 + l_orderkey * 11) % 985 AS INTEGER) AS x, CAST((l_orderkey * 13 + l_linenumber * 101) % 740 AS INTEGER) AS y,
  CAST(floor(l_quantity / 5) + 2 AS INTEGER) AS w, l_linenumber + 2 AS h, l_linenumber * 25 + 15 AS shade FROM lineitem)"""


@query(f"""WITH RECURSIVE {_MARKS},
e AS (SELECT a.page, a.no AS a, b.no AS b FROM marks a JOIN marks b ON a.page = b.page AND a.x <= b.x + b.w AND b.x <= a.x + a.w AND a.y <= b.y + b.h AND b.y <= a.y + a.h),
r AS (SELECT page, no AS a, no AS b FROM marks UNION SELECT r.page, r.a, e.b FROM r JOIN e ON r.page = e.page AND r.b = e.a),
c AS (SELECT page, a AS no, min(b) AS root FROM r GROUP BY ALL),
px AS (SELECT DISTINCT page, root, x + i AS x, y + j AS y FROM (SELECT page, root, x, y, w, h, unnest(range(w)) AS i FROM marks JOIN c USING (page, no)), LATERAL (SELECT unnest(range(h)) AS j))
SELECT page, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM px GROUP BY page, root""")
def tile_components(spark, sf_dir):
    """Components of pages of 1000 x 760 pixels, labelled tile by tile and joined over the tiles' borders."""
    return P.components(P.drawn_tiles(_marks(spark, sf_dir)), level=P.PAPER)


@query(f"""WITH {_MARKS}, b AS (SELECT page, no, greatest(x - 1, 0) AS x, greatest(y - 1, 0) AS y, least(x + w + 1, {WIDTH}) AS x1, least(y + h + 1, {HEIGHT}) AS y1 FROM marks),
px AS (SELECT page, no, x, y, x1, y1, i AS px, j AS py FROM (SELECT *, unnest(range(x, x1)) AS i FROM b), LATERAL (SELECT unnest(range(y, y1)) AS j)),
near AS (SELECT b.page, b.no, m.x, m.y, m.w, m.h, m.shade FROM b JOIN marks m ON b.page = m.page AND m.x < b.x1 AND b.x < m.x + m.w AND m.y < b.y1 AND b.y < m.y + m.h),
lit AS (SELECT px.page, px.no, px.x, px.y, px.x1, px.y1, px, py, coalesce(min(n.shade), 255) AS v FROM px LEFT JOIN near n ON px.page = n.page AND px.no = n.no AND px BETWEEN n.x AND n.x + n.w - 1 AND py BETWEEN n.y AND n.y + n.h - 1 GROUP BY ALL)
SELECT page, no, x, y, x1 - x AS w, y1 - y AS h, sha256(unhex(string_agg(printf('%02x', v), '' ORDER BY py, px))) AS digest FROM lit GROUP BY page, no, x, y, x1, y1""")
def tile_crops(spark, sf_dir):
    """The pixels of each mark and one around it, stitched from the tiles that they lie in."""
    marks = _marks(spark, sf_dir)
    found = P.crops(kept(P.drawn_tiles(marks)), marks, WIDTH, HEIGHT, pad=1)
    return found.select("page", "no", "x", "y", "w", "h", F.sha2("gray", 256).alias("digest"))
