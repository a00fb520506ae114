"""One registered query for each operator, with its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import semijson as J
from ..functions import text as T
from ..operators import boxes as B
from ..operators import glossary as L
from ..operators import kernels as K
from ..operators import layout as Y
from ..operators import ocr as O
from ..operators import pixels as P
from ..operators import reading as R
from ..operators.pages import tasks
from ..sources import derive as D

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PAGE_W, PAGE_H = 1200.0, 600.0


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: The glossary of the translation queries.
GLOSSARY = [("the", "DER", False), ("Front", "正面", False), ("Back", "背面", False), ("PMS", "", True)]
ONE_TERM = [("the", "DER", False)]


def fake_engine(texts: list[str]) -> list[str]:
    return [f"[{t}]" for t in texts]


# Flagship ------------------------------------------------------------------------------------------------------------

@query(rf"""
WITH {D.LINES}, t AS (SELECT lang, trim(line) AS raw FROM lines),
r AS (SELECT lang, raw, len(regexp_extract_all(raw, '[\x{{4e00}}-\x{{9fff}}]')) AS han, len(regexp_extract_all(raw, '[A-Za-z]')) AS latin, regexp_replace(raw, '{T.CODES.replace("'", "''")}', '', 'g') AS masked FROM t)
SELECT lang, CASE WHEN raw = '' OR han > latin OR NOT regexp_matches(masked, '[A-Za-z]') THEN 'skip' ELSE 'engine' END AS engine, '' AS warn, count(*) AS n, count(DISTINCT raw) AS texts
FROM r GROUP BY ALL""")
def flagship_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines, distinct, routed, codes masked, translated by a fake engine, codes restored, joined back and counted."""
    done = L.translate(D.text_lines(spark, sf_dir), ONE_TERM, fake_engine, "line")
    return done.groupBy("lang", "engine", "warn").agg(F.count("*").alias("n"), F.countDistinct(F.trim("line")).alias("texts"))


# Boxes ---------------------------------------------------------------------------------------------------------------

@query(f"""WITH {D.BOXES} SELECT page, no, w * h AS area, x + w / 2 AS cx, y + h / 2 AS cy, least(greatest(x, 100.0), 500.0) AS clamped,
  (400 BETWEEN x AND x + w AND 200 BETWEEN y AND y + h) AS inside FROM boxes""")
def box_scalars(spark, sf_dir):
    b, (cx, cy) = G.Box.of(), G.centre(G.Box.of())
    return D.boxes(spark, sf_dir).select("page", "no", G.area(b).alias("area"), cx.alias("cx"), cy.alias("cy"), G.clamp(b.x, 100.0, 500.0).alias("clamped"), G.contains(b, F.lit(400.0), F.lit(200.0)).alias("inside"))


@query(f"""WITH {D.BOXES}, c AS (SELECT page, no, least(greatest(x - 25, 0), {PAGE_W}) AS x0, least(greatest(y - 25, 0), {PAGE_H}) AS y0,
  least(greatest(x + w + 25, 0), {PAGE_W}) AS x1, least(greatest(y + h + 25, 0), {PAGE_H}) AS y1 FROM boxes)
SELECT page, no, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM c""")
def box_expand(spark, sf_dir):
    return D.boxes(spark, sf_dir).select("page", "no", *[c.alias(n) for n, c in zip("xywh", G.expand(G.Box.of(), 25.0, PAGE_W, PAGE_H), strict=True)])


_PAIR = f"""WITH {D.BOXES}, p AS (SELECT a.page, a.no AS no_a, b.no AS no_b, a.x AS ax, a.y AS ay, a.w AS aw, a.h AS ah, b.x AS bx, b.y AS "by", b.w AS bw, b.h AS bh,
  least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ox, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oy
  FROM boxes a JOIN boxes b ON a.page = b.page AND a.no < b.no),
m AS (SELECT *, CASE WHEN ox > 0 AND oy > 0 THEN ox * oy ELSE 0 END AS shared FROM p)"""


@query(_PAIR + """ SELECT page, no_a, no_b, shared, ox > 0 AND oy > 0 AS hit, shared / (aw * ah + bw * bh - shared) AS iou, shared / least(aw * ah, bw * bh) AS ratio,
  least(ax, bx) AS ux, greatest(ax + aw, bx + bw) - least(ax, bx) AS uw FROM m""")
def box_pair_metrics(spark, sf_dir):
    a, b = B.Box_ab()
    u = G.union(a, b)
    return B.pairs(D.boxes(spark, sf_dir)).select("page", "no_a", "no_b", G.shared_area(a, b).alias("shared"), G.intersects(a, b).alias("hit"), G.iou(a, b).alias("iou"), G.overlap_ratio(a, b).alias("ratio"), u.x.alias("ux"), u.w.alias("uw"))


@query(_PAIR + " SELECT page, no_a, no_b, shared / least(aw * ah, bw * bh) AS ratio FROM m WHERE shared / least(aw * ah, bw * bh) > 0.3")
def box_overlap_join(spark, sf_dir):
    return B.overlap_pairs(D.boxes(spark, sf_dir)).select("page", "no_a", "no_b", "ratio")


@query(_PAIR + " SELECT page, no_a, no_b, shared / least(aw * ah, bw * bh) AS ratio FROM m WHERE shared / least(aw * ah, bw * bh) > 0.3")
def box_overlap_grid_join(spark, sf_dir):
    return B.grid_overlap_pairs(D.boxes(spark, sf_dir)).select("page", "no_a", "no_b", "ratio")


@query(_PAIR + """, g AS (SELECT *, greatest(ax, bx) - least(ax + aw, bx + bw) AS gap, least(ah, bh) AS lo, greatest(ah, bh) AS hi FROM m)
SELECT page, no_a, no_b, gap FROM g WHERE oy >= 0.55 * lo AND hi <= 1.8 * lo AND gap <= 1.2 * hi AND gap >= -0.35 * hi""")
def box_merge_candidates(spark, sf_dir):
    return B.merge_candidates(D.boxes(spark, sf_dir)).select("page", "no_a", "no_b", "gap")


@query(f"""WITH {D.BOXES}, j AS (SELECT a.page, a.no, a.x, a.y, a.w, a.h, b.x AS bx, b.y AS "by", b.w AS bw, b.h AS bh,
  least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) > 0 AS col, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) > 0 AS row_
  FROM boxes a LEFT JOIN boxes b ON a.page = b.page AND a.no <> b.no),
k AS (SELECT page, no, x, y, w, h, max(CASE WHEN col AND "by" + bh <= y THEN "by" + bh + 3 END) AS up, min(CASE WHEN col AND "by" >= y + h THEN "by" - 3 END) AS down,
  max(CASE WHEN row_ AND bx + bw <= x THEN bx + bw + 3 END) AS before_, min(CASE WHEN row_ AND bx >= x + w THEN bx - 3 END) AS after_ FROM j GROUP BY ALL),
l AS (SELECT page, no, least(greatest(y - 0.35 * h / 2, up, 0), y) AS top, greatest(least(y + h + 0.35 * h / 2, down, {PAGE_H}), y + h) AS bottom,
  least(greatest(before_, 0), x) AS "left", greatest(least(after_, {PAGE_W}), x + w) AS "right" FROM k)
SELECT *, greatest(1.0, bottom - top) AS allow_h FROM l""")
def box_neighbour_limits(spark, sf_dir):
    return B.neighbour_limits(D.boxes(spark, sf_dir), PAGE_W, PAGE_H)


@query(f"""WITH {D.BOXES}, g AS (SELECT page, quantile_disc(h, 0.5) AS gh FROM boxes GROUP BY page),
c AS (SELECT page, no, w, h, floor(w * h * (no % 8) / 10) AS ink, CASE WHEN gh > 0 THEN least(gh * 2, 32) ELSE 0 END AS cap FROM boxes JOIN g USING (page))
SELECT page, no, CASE WHEN NOT (w >= 1 AND h >= 1) THEN 'empty' WHEN h < 6 THEN 'too_short' WHEN ink < 3 THEN 'too_little_ink' WHEN ink / (w * h) < 0.06 THEN 'density_low'
  WHEN NOT (cap > 0 AND w <= cap AND h <= cap) AND ink / (w * h) > 0.62 THEN 'density_high' WHEN w / h < 0.4 THEN 'too_narrow' WHEN w / h > 400 THEN 'too_wide' END AS reason FROM c""")
def box_validate(spark, sf_dir):
    b = B.with_glyph_height(D.boxes(spark, sf_dir)).withColumn("ink", F.floor(F.col("w") * F.col("h") * (F.col("no") % 8) / 10))
    return b.select("page", "no", B.box_fault(G.Box.of(), F.col("ink"), F.col("glyph_h")).alias("reason"))


@query(f"WITH {D.BOXES} SELECT page, no, row_number() OVER (PARTITION BY page ORDER BY floor(y / 16), x, y, no) AS rank FROM boxes")
def box_reading_order(spark, sf_dir):
    return B.reading_order(D.boxes(spark, sf_dir)).select("page", "no", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {D.BOXES}, r AS (SELECT page, no, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, no) AS rank FROM boxes WHERE w >= 8 AND h >= 6) SELECT * FROM r WHERE rank <= 4")
def region_top_k(spark, sf_dir):
    return B.top_regions(D.boxes(spark, sf_dir)).select("page", "no", F.col("rank").cast("long").alias("rank"))


@query(f"""WITH {D.BOXES}, i AS (SELECT page, no, w, h, floor(w * h * (no % 10) / 10) AS ink, no AS lines FROM boxes)
SELECT page, no, least(1.0, 0.5 * CASE WHEN ink / (w * h) BETWEEN 0.06 AND 0.62 THEN 1.0 ELSE 0.35 END + 0.12 * least(lines, 6)) AS score FROM i""")
def region_score(spark, sf_dir):
    ink = F.floor(F.col("w") * F.col("h") * (F.col("no") % 10) / 10)
    return D.boxes(spark, sf_dir).select("page", "no", G.region_score(ink, F.col("w"), F.col("h"), F.col("no")).alias("score"))


@query()
def items_dedupe_overlapping(spark, sf_dir):
    return B.dedupe_overlapping(D.boxes(spark, sf_dir))


@query(f"""WITH RECURSIVE {D.BOXES},
o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY -length(CASE WHEN dst <> '' THEN dst ELSE src END), w * h, no) AS k FROM boxes),
f AS (SELECT page, 1 AS k, [{{'x': x, 'y': y, 'w': w, 'h': h, 'no': no}}] AS kept FROM o WHERE k = 1
  UNION ALL
  SELECT f.page, o.k, CASE WHEN len(list_filter(f.kept, lambda b:
      CASE WHEN least(o.x + o.w, b.x + b.w) > greatest(o.x, b.x) AND least(o.y + o.h, b.y + b.h) > greatest(o.y, b.y)
      THEN (least(o.x + o.w, b.x + b.w) - greatest(o.x, b.x)) * (least(o.y + o.h, b.y + b.h) - greatest(o.y, b.y)) / least(o.w * o.h, b.w * b.h) ELSE 0 END > 0.42)) > 0
    THEN f.kept ELSE list_append(f.kept, {{'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h, 'no': o.no}}) END
  FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1),
l AS (SELECT page, kept FROM f QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1),
u AS (SELECT page, unnest(range(len(kept))) AS pos, unnest(kept) AS item FROM l)
SELECT page, CAST(pos AS INTEGER) AS pos, item.no AS no FROM u""")
def items_collapse(spark, sf_dir):
    return B.collapse_overlapping(D.boxes(spark, sf_dir)).select("page", "pos", "no")


@query()
def items_dedupe_same_text(spark, sf_dir):
    return B.dedupe_same_text(D.boxes(spark, sf_dir))


@query()
def items_merge_adjacent(spark, sf_dir):
    return B.merge_adjacent(D.boxes(spark, sf_dir))


@query()
def boxes_group_blocks(spark, sf_dir):
    return B.group_blocks(D.boxes(spark, sf_dir))


@query()
def items_prepare(spark, sf_dir):
    return B.prepare_items(D.boxes(spark, sf_dir))


# Coordinates ---------------------------------------------------------------------------------------------------------

def _raw() -> list:
    return [F.col("x") - 200, F.col("y") * 2, F.col("x") + F.col("w"), F.col("y") * 2 - F.col("h")]


_NORM = f"""WITH {D.BOXES}, r AS (SELECT page, no, x, y, w, h, least(abs(x - 200), 1080) AS a, least(abs(y * 2), 1080) AS b, least(abs(x + w), 1080) AS c, least(abs(y * 2 - h), 1080) AS d FROM boxes),
n AS (SELECT page, no, least(a, c) AS x0, least(b, d) AS y0, greatest(a, c, least(a, c) + 6) AS x1, greatest(b, d, least(b, d) + 6) AS y1 FROM r)"""


@query(_NORM + " SELECT * FROM n")
def box_normalise_1000(spark, sf_dir):
    v = D.boxes(spark, sf_dir).withColumn("v", G.normalise_1000(_raw()))
    return v.select("page", "no", *[F.col("v")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))])


@query(_NORM + """, f AS (SELECT page, no, least(greatest(100 + x0 / 1000 * 300, 0), 1200) AS x0, least(greatest(50 + y0 / 1000 * 200, 0), 600) AS y0,
  least(greatest(100 + x1 / 1000 * 300, 0), 1200) AS x1, least(greatest(50 + y1 / 1000 * 200, 0), 600) AS y1 FROM n),
g AS (SELECT page, no, x0, y0, CASE WHEN x1 <= x0 + 1 THEN least(1200, x0 + 2) ELSE x1 END AS ex, CASE WHEN y1 <= y0 + 1 THEN least(600, y0 + 2) ELSE y1 END AS ey, x1 <= x0 + 1 AS tx, y1 <= y0 + 1 AS ty FROM f),
k AS (SELECT page, no, CASE WHEN tx THEN greatest(0, least(x0, ex - 2)) ELSE x0 END AS x, CASE WHEN ty THEN greatest(0, least(y0, ey - 2)) ELSE y0 END AS y, ex, ey FROM g)
SELECT page, no, x, y, ex - x AS w, ey - y AS h FROM k""")
def box_map_from_crop(spark, sf_dir):
    b = G.map_from_crop(G.normalise_1000(_raw()), 100.0, 50.0, 300.0, 200.0, PAGE_W, PAGE_H)
    return D.boxes(spark, sf_dir).select("page", "no", *[c.alias(n) for n, c in zip("xywh", b, strict=True)])


@query(f"""WITH {D.BOXES}, p AS (SELECT page, no, x, y, w, h, greatest(4.0, floor(greatest(w, h) * 0.12 + 0.5)) AS pad FROM boxes),
e AS (SELECT page, no, pad, least(greatest(x - pad, 0), {PAGE_W}) AS x0, least(greatest(y - pad, 0), {PAGE_H}) AS y0, least(greatest(x + w + pad, 0), {PAGE_W}) AS x1, least(greatest(y + h + pad, 0), {PAGE_H}) AS y1 FROM p),
s AS (SELECT *, greatest(x1 - x0, y1 - y0) AS side FROM e)
SELECT page, no, pad, x1 - x0 AS w, y1 - y0 AS h, CASE WHEN side * least(greatest(640 / side, 1), 4) > 1400 THEN greatest(1400 / side, 0) ELSE least(greatest(640 / side, 1), 4) END AS scale FROM s""")
def region_crop_plan(spark, sf_dir):
    c = G.crop_for_region(G.Box.of(), PAGE_W, PAGE_H)
    return D.boxes(spark, sf_dir).select("page", "no", *[c[k].alias(k) for k in ("pad", "w", "h", "scale")])


@query(f"""WITH {D.BOXES}, v AS (SELECT page, no, w * 10 AS px, h * 10 AS py, CASE WHEN no % 3 = 0 THEN w END AS pw, CASE WHEN no % 3 = 0 THEN h END AS ph, CASE WHEN no % 3 = 1 THEN 2.5 END AS s FROM boxes)
SELECT page, no, CASE WHEN pw > 0 AND ph > 0 THEN pw WHEN s > 0 THEN px / s ELSE px END AS w_pt, CASE WHEN pw > 0 AND ph > 0 THEN ph WHEN s > 0 THEN py / s ELSE py END AS h_pt,
  CASE WHEN pw > 0 AND ph > 0 THEN 72 * px / pw WHEN s > 0 THEN 72 * s ELSE 72.0 END AS dpi, coalesce(pw > 0 AND ph > 0, false) OR coalesce(s > 0, false) AS exact FROM v""")
def page_size_rule(spark, sf_dir):
    w, h, no = F.col("w"), F.col("h"), F.col("no")
    s = G.page_size(w * 10, h * 10, F.when(no % 3 == 0, w), F.when(no % 3 == 0, h), F.when(no % 3 == 1, 2.5))
    return D.boxes(spark, sf_dir).select("page", "no", *[c.alias(k) for k, c in s.items()])


# Text ----------------------------------------------------------------------------------------------------------------

def _text(spark, sf_dir) -> DataFrame:
    """Document lines and the awkward samples, keyed."""
    lines = D.text_lines(spark, sf_dir).select(F.col("doc_id").alias("k"), F.col("line_no").alias("no"), F.col("line"))
    return lines.unionByName(D.samples(spark).select(F.lit(-1).cast("long").alias("k"), "no", "line"))


_TEXT = f"WITH {D.LINES}, {D.SAMPLE_ROWS}, t AS (SELECT doc_id AS k, line_no AS no, line FROM lines UNION ALL SELECT -1, no, line FROM samples)"
_HAN = r"[\x{4e00}-\x{9fff}]"
_N = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[‘’“”]', '''', 'g'), '[^a-z0-9\x{{4e00}}-\x{{9fff}}]', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"WITH {D.LINES} SELECT doc_id, line_no, line FROM lines")
def text_split_lines(spark, sf_dir):
    return D.text_lines(spark, sf_dir).select("doc_id", "line_no", "line")


@query(_TEXT + f" SELECT k, no, {_N.format('line')} AS norm FROM t")
def text_norm(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", T.norm_text(F.col("line")).alias("norm"))


_PAIRS_SQL = """WITH p AS (SELECT p_partkey AS k, p_name AS a, lead(p_name) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS b FROM part),
n AS (SELECT k, """ + _N.format("a") + " AS x, " + _N.format("b") + """ AS y FROM p WHERE b IS NOT NULL),
s AS (SELECT *, CASE WHEN x = '' AND y = '' THEN 1.0 WHEN x = '' OR y = '' THEN 0.0 ELSE 1 - levenshtein(x, y) / greatest(length(x), length(y)) END AS sim FROM n)"""


def _name_pairs(spark, sf_dir):
    after = F.lead("p_name").over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    return D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("a"), after.alias("b")).where("b IS NOT NULL")


@query(_PAIRS_SQL + " SELECT k, sim FROM s")
def text_similarity(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("k", T.similarity(F.col("a"), F.col("b")).alias("sim"))


@query(_PAIRS_SQL + " SELECT k, least(length(x), length(y)) > 0 AND (x = y OR ((contains(x, y) OR contains(y, x)) AND least(length(x), length(y)) / greatest(length(x), length(y)) >= 0.6) OR sim >= 0.82) AS same FROM s")
def text_same(spark, sf_dir):
    return _name_pairs(spark, sf_dir).select("k", T.same_text(F.col("a"), F.col("b")).alias("same"))


@query(_TEXT + r""", a AS (SELECT k, no, regexp_replace(regexp_replace(regexp_replace(line, '[\x{a0}\r\n\t]', ' ', 'g'), ' {2,}', ' ', 'g'), '^[\s·•\-–—:：]+', '') AS s FROM t),
b AS (SELECT k, no, CASE WHEN regexp_matches(s, '^[''"“”‘’][A-Za-z0-9\x{4e00}-\x{9fff}]') THEN substr(s, 2) ELSE s END AS s FROM a),
c AS (SELECT k, no, regexp_replace(s, '[\s·•\-–—:：]+$', '') AS s FROM b)
SELECT k, no, trim(regexp_replace(s, '([^0-9])[''"“”‘’]$', '\1')) AS cleaned FROM c""")
def text_clean(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", T.clean_text(F.col("line")).alias("cleaned"))


@query(_TEXT + r""" SELECT k, no, trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(line, '/f_', 'f'), '/_/', ''), '/ffl', 'ffl'), '/ff', 'ff'), '/fi', 'fi'), '/fl', 'fl'), chr(65533), ''), '\s+', ' ', 'g')) AS cleaned FROM t""")
def text_clean_pdf(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", T.clean_pdf_text(F.col("line")).alias("cleaned"))


@query(_TEXT + r""" SELECT k, no, trim(regexp_replace(regexp_replace(regexp_replace(line, '\s+([，。；：！？、）】」』])', '\1', 'g'), '([（【「『])\s+', '\1', 'g'), '[ \t]{2,}', ' ', 'g')) AS cleaned FROM t""")
def text_cleanup_punct(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", T.cleanup_punct(F.col("line")).alias("cleaned"))


@query(_TEXT + rf""", j AS (SELECT k, no, line AS a, lead(line) OVER (PARTITION BY k ORDER BY no) AS b FROM t), c AS (SELECT k, no, a, coalesce(b, '') AS b, trim(a) AS ta, trim(coalesce(b, '')) AS tb FROM j)
SELECT k, no, CASE WHEN ta = '' THEN tb WHEN tb = '' THEN ta ELSE ta || ' ' || tb END AS src,
  CASE WHEN a = '' OR b = '' OR regexp_matches(a, '[\x{{3000}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}}\s]$') OR regexp_matches(b, '^[\x{{3000}}-\x{{30ff}}\x{{3400}}-\x{{4dbf}}\x{{4e00}}-\x{{9fff}}\x{{ff00}}-\x{{ffef}}\s]') THEN a || b ELSE a || ' ' || b END AS dst FROM c""")
def text_join(spark, sf_dir):
    t = _text(spark, sf_dir).withColumn("b", F.lead("line").over(Window.partitionBy("k").orderBy("no")))
    return t.select("k", "no", T.join_src(F.col("line"), F.col("b")).alias("src"), T.join_dst(F.col("line"), F.col("b")).alias("dst"))


@query(_TEXT + rf""", s AS (SELECT k, no, trim(line) AS s, CASE WHEN no % 5 = 0 THEN 20.0 ELSE 90.0 END AS conf FROM t)
SELECT k, no, length(s) < 2 OR conf < 35 OR NOT regexp_matches(s, '[A-Za-z\x{{4e00}}-\x{{9fff}}]') OR (length(regexp_replace(s, '\s', '', 'g')) > 1 AND len(list_distinct(string_split(regexp_replace(s, '\s', '', 'g'), ''))) = 1)
  OR len(regexp_extract_all(s, '[^A-Za-z0-9\x{{4e00}}-\x{{9fff}}\s]')) > length(s) * 0.5 OR (length(regexp_replace(s, '[^A-Za-z]', '', 'g')) >= 5 AND NOT regexp_matches(regexp_replace(s, '[^A-Za-z]', '', 'g'), '[aeiouAEIOU]')) AS noise,
  regexp_matches(s, '[A-Za-z0-9\x{{4e00}}-\x{{9fff}}]') AS readable, len(regexp_extract_all(s, '{_HAN}')) > len(regexp_extract_all(s, '[A-Za-z]')) AS han FROM s""")
def text_noise(spark, sf_dir):
    conf = F.when(F.col("no") % 5 == 0, 20.0).otherwise(90.0)
    return _text(spark, sf_dir).select("k", "no", T.looks_like_noise(F.col("line"), conf).alias("noise"), T.looks_readable(F.col("line")).alias("readable"), T.is_mostly_han(F.col("line")).alias("han"))


@query(_TEXT + rf""", s AS (SELECT k, no, trim(line) AS s FROM t), c AS (SELECT *, len(regexp_extract_all(s, '[A-Za-z]')) + len(regexp_extract_all(s, '{_HAN}')) AS n FROM s)
SELECT k, no, CASE WHEN s = '' THEN 'normal' WHEN regexp_matches(s, '(?i)^(PMS|SKU|ITEM|ART|MODEL)\b') OR regexp_matches(s, '(?i)^[\d\s.,%''"/x×\-+]+$') OR regexp_matches(s, '(?i)^[\d.,]+\s*(in|inch|cm|mm|m|ft|kg|g|oz|lb|pcs?|%)$') THEN 'code'
  WHEN n >= 22 OR regexp_matches(s, '[.。;；]') THEN 'note' WHEN regexp_matches(s, '^[A-Z0-9\s/&.\-]{{2,}}$') OR n <= 14 THEN 'label' ELSE 'normal' END AS kind FROM c""")
def text_classify_field(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", T.classify_field(F.col("line")).alias("kind"))


@query(_TEXT + " SELECT k, no, translate(line, '０１２３４５６７８９', '0123456789') AS digits, CASE WHEN no % 2 = 0 THEN 'Traditional Chinese' ELSE 'Simplified Chinese' END AS lang FROM t")
def text_digits_and_language(spark, sf_dir):
    code = F.when(F.col("no") % 2 == 0, "zh-TW").when(F.col("no") % 3 == 0, "zh-CN").otherwise("?")
    return _text(spark, sf_dir).select("k", "no", T.ascii_digits(F.col("line")).alias("digits"), T.lang_name(code).alias("lang"))


@query()
def text_fnv1a(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", T.fnv1a(F.col("line")).alias("key"))


@query()
def text_split_for_limit(spark, sf_dir):
    docs = D.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(L.split_pieces(F.col("text"))).alias("part", "piece"))
    return docs.select("doc_id", "part", F.length("piece").alias("n"), F.md5("piece").alias("digest"))


@query("""SELECT r_regionkey AS k, CASE WHEN regexp_matches(f, '(?i)\\.pdf$') THEN 'pdf' WHEN regexp_matches(f, '(?i)\\.(png|jpe?g|webp|bmp|gif)$') THEN 'image' END AS kind, regexp_replace(f, '\\.[^.]*$', '') || '-zh.pdf' AS output
FROM (SELECT r_regionkey, r_name || ['.pdf', '.PNG', '.txt', '.jpeg', '.tar.gif'][CAST(r_regionkey % 5 + 1 AS INTEGER)] AS f FROM region)""".replace("\\\\", "\\"))
def file_classify(spark, sf_dir):
    f = F.concat("r_name", F.element_at(F.array(*map(F.lit, (".pdf", ".PNG", ".txt", ".jpeg", ".tar.gif"))), (F.col("r_regionkey") % 5 + 1).cast("int")))
    return D.table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), T.file_kind(f, F.lit("")).alias("kind"), T.output_stem(f, "-zh.pdf").alias("output"))


#: What stands after a page's host in the service addresses made from it.
_SERVICE_PATHS = ("", "/", "/v1/", "/v4beta", "/v1/chat/completions", "/v1/models//")


def _addresses(spark, sf_dir):
    """A service address from each page's: its host, the special one among them, and a path; and a status."""
    host = F.when(F.col("page_id") % 7 == 0, "https://api.deepseek.com").otherwise(F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0))
    path = F.get(F.array(*map(F.lit, _SERVICE_PATHS)), (F.col("page_id") % len(_SERVICE_PATHS)).cast("int"))
    return D.table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), F.concat(host, path).alias("url"), (F.col("page_id") * 37 % 600).cast("int").alias("status"))


_ADDRESSES_SQL = f"""WITH a AS (SELECT page_id AS k, CASE WHEN page_id % 7 = 0 THEN 'https://api.deepseek.com' ELSE regexp_extract(url, '^[a-z]+://[^/?#]+') END
  || {list(_SERVICE_PATHS)}[CAST(page_id % {len(_SERVICE_PATHS)} AS INTEGER) + 1] AS url, CAST(page_id * 37 % 600 AS INTEGER) AS status FROM pages), s AS (SELECT k, status, regexp_replace(trim(url), '/+$', '') AS u FROM a)"""


@query(_ADDRESSES_SQL + """ SELECT k, CASE WHEN u LIKE '%/chat/completions' THEN u WHEN u = 'https://api.deepseek.com' OR regexp_matches(u, '/v[0-9]+[a-z0-9]*$') THEN u || '/chat/completions' ELSE u || '/v1/chat/completions' END AS endpoint,
  status = 408 OR status = 429 OR status >= 500 AS again FROM s""")
def endpoint_rules(spark, sf_dir):
    return _addresses(spark, sf_dir).select("k", T.chat_endpoint(F.col("url")).alias("endpoint"), T.retryable(F.col("status")).alias("again"))


# Glossary and translation --------------------------------------------------------------------------------------------

#: How a part's name becomes a line of its brand's glossary: before it, after it.
GLOSSARY_FORMS = (("# ", ""), ("// ", ""), ("", " => 甲"), ("", " -> 乙"), ("", " :: 丙"), ("", " = 丁"), ("", ""), ("", " => keep"), ("  ", "  ＝ 戊 "), ("=> ", ""), ("", "＝>己"), ("", " → 不译"))


def _glossary_lines(spark, sf_dir):
    """A glossary a brand, whose lines are the names of its parts in all forms of an entry."""
    form = (F.col("p_partkey") % len(GLOSSARY_FORMS)).cast("int")
    before, after = (F.array(*[F.lit(f[i]) for f in GLOSSARY_FORMS]) for i in (0, 1))
    return D.table(spark, sf_dir, "part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("no"), F.concat(F.get(before, form), "p_name", F.get(after, form)).alias("line"))


_FORMS_SQL = ", ".join(f"({i}, '{b}', '{a}')" for i, (b, a) in enumerate(GLOSSARY_FORMS))


@query(rf"""WITH f(i, b, a) AS (VALUES {_FORMS_SQL}), g AS (SELECT p_brand AS brand, p_partkey AS no, b || p_name || a AS line FROM part JOIN f ON p_partkey % {len(GLOSSARY_FORMS)} = i),
s AS (SELECT brand, no, trim(line) AS s FROM g), f2 AS (SELECT * FROM s WHERE s <> '' AND NOT regexp_matches(s, '^(#|//)')),"""
       r"""c AS (SELECT brand, no, s, list_filter([{'p': instr(s, '=>'), 'n': 2}, {'p': instr(s, '＝>'), 'n': 2}, {'p': instr(s, '->'), 'n': 2}, {'p': instr(s, '→'), 'n': 1}, {'p': instr(s, '::'), 'n': 2}, {'p': instr(s, '＝'), 'n': 1}, {'p': instr(s, '='), 'n': 1}], lambda e: e.p > 1) AS e FROM f2),
t AS (SELECT brand, no, CASE WHEN len(e) = 0 THEN s ELSE trim(substr(s, 1, e[1].p - 1)) END AS term, CASE WHEN len(e) = 0 THEN '' ELSE trim(substr(s, e[1].p + e[1].n)) END AS target FROM c)
SELECT brand, no, term, target, target = '' OR regexp_matches(target, '(?i)^(原样|保持原样|keep|keep as is|keep as-is|不译|不翻译|-|—)$') AS keep FROM t WHERE term <> ''""")
def glossary_parse(spark, sf_dir):
    return L.parse_glossary(_glossary_lines(spark, sf_dir)).drop("line")


@query()
def glossary_prompt_blocks(spark, sf_dir):
    return L.glossary_prompt(glossary_parse(spark, sf_dir), "brand")


@query(_TEXT + r""" SELECT k, no, regexp_replace(regexp_replace(line, '(^|[^A-Za-z0-9_])(?i:the)($|[^A-Za-z0-9_])', '\1DER\2', 'g'), '(^|[^A-Za-z0-9_])(?i:the)($|[^A-Za-z0-9_])', '\1DER\2', 'g') AS replaced FROM t""")
def glossary_apply_one(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", L.apply_glossary(F.col("line"), ONE_TERM).alias("replaced"))


@query()
def glossary_apply_many(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", L.apply_glossary(F.col("line"), GLOSSARY).alias("replaced"))


_CODES_SQL = T.CODES.replace("'", "''")


@query(_TEXT + f" SELECT k, no, array_to_string(regexp_extract_all(line, '{_CODES_SQL}'), '|') AS codes, len(regexp_extract_all(line, '{_CODES_SQL}')) AS n FROM t")
def codes_extract(spark, sf_dir):
    return _text(spark, sf_dir).select("k", "no", F.array_join(T.codes(F.col("line")), "|").alias("codes"), F.size(T.codes(F.col("line"))).cast("long").alias("n"))


@query(_TEXT + f" SELECT k, no, line AS restored, regexp_matches(regexp_replace(line, '{_CODES_SQL}', '', 'g'), '[A-Za-z]') AS latin_left, 0 AS lost FROM t")
def codes_round_trip(spark, sf_dir):
    t = _text(spark, sf_dir).withColumn("p", T.protected(F.col("line"))).select("k", "no", "p.codes", "p.masked")
    t = t.withColumn("restored", T.restore_codes(F.col("masked"), F.col("codes")))
    return t.select("k", "no", "restored", F.col("masked").rlike("[A-Za-z]").alias("latin_left"), F.size(T.lost_codes(F.col("restored"), F.col("codes"))).alias("lost"))


@query(_TEXT + rf""", r AS (SELECT k, no, line, regexp_replace(line, '{_CODES_SQL}', '', 'g') AS masked FROM t)
SELECT k, no, CASE WHEN trim(line) = '' THEN 'blank' WHEN len(regexp_extract_all(line, '{_HAN}')) > len(regexp_extract_all(line, '[A-Za-z]')) THEN 'han' WHEN NOT regexp_matches(masked, '[A-Za-z]') THEN 'codes' ELSE 'send' END AS route FROM r""")
def translate_route(spark, sf_dir):
    return L.route(_text(spark, sf_dir), ONE_TERM, "line").select("k", "no", "route")


@query()
def translate_join_back(spark, sf_dir):
    return L.translate(_text(spark, sf_dir), GLOSSARY, fake_engine, "line").select("k", "no", "dst", "engine", "warn")


@query(f"WITH {D.LINES}, d AS (SELECT DISTINCT lang, trim(line) AS raw FROM lines) SELECT lang, raw, CAST(floor((row_number() OVER (PARTITION BY lang ORDER BY raw COLLATE C) - 1) / 24) AS BIGINT) AS batch FROM d".replace(" COLLATE C", ""))
def translate_batches(spark, sf_dir):
    d = D.text_lines(spark, sf_dir).select("lang", F.trim("line").alias("raw")).distinct()
    return L.request_batches(d)


# JSON ----------------------------------------------------------------------------------------------------------------

def _replies(spark, sf_dir):
    """Replies that quote a turn's whole text: untidy ones (bare keys, trailing commas) and well-formed ones in turn."""
    said = F.coalesce("text", F.lit(""))
    quoted = F.regexp_replace(F.to_json(F.struct(said.alias("t"))), r'^\{"t":|\}$', "")
    turn = F.col("turn").cast("string")
    untidy = F.concat(F.lit("{items:[{text:"), quoted, F.lit(',translation:"T '), turn, F.lit('",box:[0,0,10,10],},],}'))
    tidy = F.concat(F.lit('{"items":[{"text":'), quoted, F.lit(',"translation":"T '), turn, F.lit('","box":[0,0,10,10]}]}'))
    body = F.concat(F.lit("Sure:\n```json\n"), F.when(F.col("turn") % 2 == 0, untidy).otherwise(tidy), F.lit("\n```"))
    return D.table(spark, sf_dir, "conversations").select("conv_id", "turn", said.alias("said"), body.alias("body"))


#: The same replies' texts for a second engine: whole, and as they stand quoted in JSON.
_REPLIES = "WITH r AS (SELECT conv_id, turn, coalesce(text, '') AS said, CAST(to_json(coalesce(text, '')) AS VARCHAR) AS quoted FROM conversations)"
_TRIMMED = r"regexp_replace(said, '^\s+|\s+$', '', 'g')"


@query(_REPLIES + """ SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '{items:[{text:' || quoted || ',translation:"T ' || turn || '",box:[0,0,10,10],},],}'
  ELSE '{"items":[{"text":' || quoted || ',"translation":"T ' || turn || '","box":[0,0,10,10]}]}' END AS inner_text FROM r""")
def json_strip_fences(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", T.strip_fences(F.col("body")).alias("inner_text"))


@query(_REPLIES + """ SELECT conv_id, turn, '{"items":[{"text":' || quoted || ',"translation":"T ' || turn || '","box":[0,0,10,10]}]}' AS repaired FROM r""")
def json_repair(spark, sf_dir):
    return _replies(spark, sf_dir).select("conv_id", "turn", T.repair_json(T.strip_fences(F.col("body"))).alias("repaired"))


@query(_REPLIES + " SELECT conv_id, turn, 0 AS item_no, said AS src, 'T ' || turn AS dst, 20.0 AS box_sum FROM r")
def json_typed_items(spark, sf_dir):
    rows = _replies(spark, sf_dir).select("conv_id", "turn", F.posexplode(J.typed_items(F.col("body"))).alias("item_no", "i"))
    return rows.select("conv_id", "turn", "item_no", F.col("i.text").alias("src"), F.col("i.translation").alias("dst"), F.aggregate("i.box", F.lit(0.0), lambda a, x: a + x).alias("box_sum"))


@query(_REPLIES + f" SELECT conv_id, turn, 0 AS item_no, {_TRIMMED} AS src, 'T ' || turn AS dst FROM r")
def json_parse_replies(spark, sf_dir):
    return J.parse_replies(_replies(spark, sf_dir).drop("said")).select("conv_id", "turn", "item_no", "src", "dst")


@query(_REPLIES + " SELECT conv_id, turn, said || 'tail' AS said FROM r")
def json_model_text(spark, sf_dir):
    c = _replies(spark, sf_dir)
    part = lambda t: F.struct(t.alias("text"))
    gemini = F.to_json(F.struct(F.array(F.struct(F.struct(F.array(part(F.col("said")), part(F.lit("tail"))).alias("parts")).alias("content"))).alias("candidates")))
    openai = F.to_json(F.struct(F.array(F.struct(F.struct(F.concat("said", F.lit("tail")).alias("content")).alias("message"))).alias("choices")))
    return c.select("conv_id", "turn", J.model_text(F.when(F.col("turn") % 2 == 0, gemini).otherwise(openai)).alias("said"))


# Recognition and text layers -----------------------------------------------------------------------------------------

def _tsv(spark, sf_dir):
    b = D.boxes(spark, sf_dir)
    conf = F.when(F.col("no") % 4 == 0, -1).otherwise(60 + F.col("no"))
    row = F.concat_ws("\t", F.lit("5"), F.lit("1"), F.lit("1"), F.lit("1"), (F.col("no") % 3).cast("string"), F.col("no").cast("string"), *[F.col(c).cast("int").cast("string") for c in "xywh"], conf.cast("string"), "src")
    return b.select("page", row.alias("line"))


@query(f"""WITH {D.BOXES} SELECT page, no % 3 AS line_num, string_agg(src, ' ' ORDER BY no) AS text, avg(CASE WHEN no % 4 <> 0 THEN 60.0 + no END) AS conf, CAST(min(x) AS INTEGER) AS x, CAST(min(y) AS INTEGER) AS y,
  CAST(max(x + w) - min(x) AS INTEGER) AS w, CAST(max(y + h) - min(y) AS INTEGER) AS h FROM boxes GROUP BY page, no % 3""")
def ocr_tsv_lines(spark, sf_dir):
    return O.tsv_lines(O.parse_tsv(_tsv(spark, sf_dir)), ("page",)).select("page", "line_num", "text", "conf", "x", "y", "w", "h")


@query()
def ocr_plan_bands(spark, sf_dir):
    return O.plan_bands(D.boxes(spark, sf_dir))


def _text_items(spark, sf_dir):
    b = D.boxes(spark, sf_dir)
    m = F.array(F.col("h"), F.lit(0.0), F.lit(0.0), F.col("h"), F.col("x"), 600 - F.col("y"))
    view = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.0, -1.0, 0.0, 600.0)])
    g = O.glyph_box(view, m, F.when(F.col("no") % 3 != 0, F.col("w")), F.col("h"), F.col("src"))
    return b.select("page", "no", *[c.alias(k) for k, c in g.items()])


@query(f"""WITH {D.BOXES}, a AS (SELECT page, no, x, y, h, CASE WHEN no % 3 <> 0 THEN w ELSE greatest(h * 0.5, length(src) * h * 0.5) END AS adv FROM boxes)
SELECT page, no, x, y - 0.85 * h AS y, adv AS w, 1.15 * h AS h, h AS font_height, y AS base_y FROM a""")
def pdf_item_boxes(spark, sf_dir):
    return _text_items(spark, sf_dir).select("page", "no", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), F.round("w", 6).alias("w"), F.round("h", 6).alias("h"), "font_height", "base_y")


SQL["pdf_item_boxes"] = SQL["pdf_item_boxes"].replace("SELECT page, no, x, y - 0.85 * h AS y, adv AS w, 1.15 * h AS h,", "SELECT page, no, round(x, 6) AS x, round(y - 0.85 * h, 6) AS y, round(adv, 6) AS w, round(1.15 * h, 6) AS h,")


@query()
def pdf_group_items(spark, sf_dir):
    return O.group_text_items(_text_items(spark, sf_dir))


@query()
def layout_fit(spark, sf_dir):
    b = D.boxes(spark, sf_dir).select("page", "no", F.col("src").alias("text"), "x", "y", "w", "h", (F.col("h") * 1.35).alias("allow_h"), F.lit(None).cast("double").alias("allow_w"))
    return Y.lay_out(b).select("page", "no", F.col("layout.font_size").alias("font_size"), F.size("layout.lines").alias("lines"), F.col("layout.overflow").alias("overflow"), F.col("layout.shrunk").alias("shrunk"))


@query(f"""WITH {D.BOXES}, m AS (SELECT page, list_sort(list(h)) AS l FROM boxes GROUP BY page), k AS (SELECT page, l[CAST(floor(len(l) / 2) AS INTEGER) + 1] AS median_h FROM m)
SELECT page, no, median_h, CASE WHEN h BETWEEN median_h * 0.7 AND median_h * 1.4 THEN median_h ELSE h END AS even_h FROM boxes JOIN k USING (page)""")
def layout_page_line_height(spark, sf_dir):
    return Y.page_line_height(D.boxes(spark, sf_dir)).select("page", "no", "median_h", "even_h")


# Pixels --------------------------------------------------------------------------------------------------------------

_PX = f"WITH {D.PLANES}"
_MASK = _PX + """, s1 AS (SELECT *, sum(lum) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s, count(*) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM planes),
mask AS (SELECT page, y, x, lum, CAST(lum < sum(s) OVER w / sum(n) OVER w - 8 AS INTEGER) AS ink FROM s1 WINDOW w AS (PARTITION BY page, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))"""


def _mask(spark, sf_dir):
    return P.adaptive_ink(D.planes(spark, sf_dir))


@query(_PX + " SELECT page, y, x, CAST(round_even(0.299 * CAST(r AS DOUBLE) + 0.587 * CAST(g AS DOUBLE) + 0.114 * CAST(b AS DOUBLE), 0) AS INTEGER) AS gray FROM planes")
def px_gray(spark, sf_dir):
    return P.to_gray(D.planes(spark, sf_dir)).select("page", "y", "x", "gray")


@query(_PX + ", a AS (SELECT page, y, x, sum(lum) OVER w AS s, sum(lum * lum) OVER w AS q FROM planes WINDOW w AS (PARTITION BY page, y ORDER BY x)) SELECT page, y, x, CAST(sum(s) OVER v AS BIGINT) AS total, CAST(sum(q) OVER v AS BIGINT) AS squares FROM a WINDOW v AS (PARTITION BY page, x ORDER BY y)")
def px_integral(spark, sf_dir):
    return P.integral(D.planes(spark, sf_dir))


@query(_PX + """, h AS (SELECT page, lum AS v, count(*) AS n FROM planes GROUP BY ALL), c AS (SELECT page, v, sum(n) OVER w AS n0, sum(n * v) OVER w AS s0, sum(n) OVER (PARTITION BY page) AS n, sum(n * v) OVER (PARTITION BY page) AS s FROM h WINDOW w AS (PARTITION BY page ORDER BY v)),
b AS (SELECT page, v, CASE WHEN n > n0 THEN CAST(s0 * n - s * n0 AS DOUBLE) * CAST(s0 * n - s * n0 AS DOUBLE) / (n0 * (n - n0)) ELSE -1.0 END AS b FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY b DESC, v) AS k FROM b)
SELECT page, CAST(CASE WHEN b > 0 THEN v ELSE 128 END AS INTEGER) AS threshold FROM r WHERE k = 1""")
def px_otsu(spark, sf_dir):
    return P.otsu(D.planes(spark, sf_dir))


@query(_MASK + " SELECT page, y, x, ink FROM mask")
def px_adaptive_threshold(spark, sf_dir):
    return _mask(spark, sf_dir).select("page", "y", "x", "ink")


@query(_MASK + ", d AS (SELECT page, y, x, max(ink) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS d FROM mask) SELECT page, y, x, max(d) OVER (PARTITION BY page, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS ink FROM d")
def px_dilate(spark, sf_dir):
    return P.dilate(_mask(spark, sf_dir), 1, 1).select("page", "y", "x", "ink")


@query(_MASK + """, a AS (SELECT *, min(ink) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS m FROM mask), e AS (SELECT *, min(m) OVER (PARTITION BY page, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS e FROM a),
b AS (SELECT *, max(e) OVER (PARTITION BY page, y ORDER BY x ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS f FROM e) SELECT page, y, x, greatest(ink - max(f) OVER (PARTITION BY page, x ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 0) AS ink FROM b""")
def px_without_blobs(spark, sf_dir):
    return P.without_blobs(_mask(spark, sf_dir)).select("page", "y", "x", "ink")


@query(_PX + """, l AS (SELECT page, lag(lum) OVER a + lead(lum) OVER a + lag(lum) OVER d + lead(lum) OVER d - 4 * lum AS l FROM planes WINDOW a AS (PARTITION BY page, y ORDER BY x), d AS (PARTITION BY page, x ORDER BY y)), v AS (SELECT page, coalesce(var_pop(l), 0) AS variance FROM l GROUP BY page)
SELECT page, round(variance, 4) AS variance, round(variance / (variance + 500), 6) AS sharpness FROM v""")
def px_laplacian_variance(spark, sf_dir):
    return P.laplacian_variance(D.planes(spark, sf_dir)).select("page", F.round("variance", 4).alias("variance"), F.round("sharpness", 6).alias("sharpness"))


@query(_MASK + " SELECT page, avg(ink) AS ratio FROM mask GROUP BY page")
def px_ink_ratio(spark, sf_dir):
    return P.ink_ratio(_mask(spark, sf_dir))


@query(_PX + """, h AS (SELECT page, lum AS v, count(*) AS n FROM planes GROUP BY ALL), c AS (SELECT page, v, sum(n) OVER (PARTITION BY page ORDER BY v) AS b, sum(n) OVER (PARTITION BY page) AS a FROM h),
e AS (SELECT page, min(v) FILTER (b >= 0.02 * a) AS lo, min(v) FILTER (b >= 0.98 * a) AS hi FROM c GROUP BY page)
SELECT page, y, x, CAST(CASE WHEN hi - lo < 8 THEN lum ELSE least(greatest(round_even((lum - lo) * least(CAST(1.6 AS DOUBLE), 255 / (hi - lo)), 0), 0), 255) END AS INTEGER) AS stretched FROM planes JOIN e USING (page)""")
def px_gray_stretch(spark, sf_dir):
    return P.gray_stretch(D.planes(spark, sf_dir))


_RUNS = _MASK + ", i AS (SELECT page, y, x, x - row_number() OVER (PARTITION BY page, y ORDER BY x) AS g FROM mask WHERE ink = 1), runs AS (SELECT page, y, min(x) AS x0, max(x) + 1 AS x1, count(*) AS ink FROM i GROUP BY page, y, g)"


@query(_RUNS + " SELECT * FROM runs")
def px_runs(spark, sf_dir):
    return P.runs(_mask(spark, sf_dir))


_BANDS = _MASK + ", rr AS (SELECT page, y, sum(ink) AS ink FROM mask GROUP BY ALL HAVING sum(ink) >= 1), gg AS (SELECT *, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM rr), bands AS (SELECT page, min(y) AS y0, max(y) + 1 AS y1, CAST(sum(ink) AS BIGINT) AS ink FROM gg GROUP BY page, g)"


@query(_BANDS + " SELECT * FROM bands")
def px_row_bands(spark, sf_dir):
    return P.row_bands(_mask(spark, sf_dir))


@query(_BANDS + " SELECT page, quantile_disc(y1 - y0, 0.5) AS height FROM bands GROUP BY page")
def px_text_height(spark, sf_dir):
    return P.text_height(_mask(spark, sf_dir))


@query("WITH RECURSIVE " + _RUNS[5:] + """, k AS (SELECT page, y, x0, x1, ink, y * 2147483648 + x0 AS id FROM runs),
e AS (SELECT a.page, a.id AS u, b.id AS v FROM k a JOIN k b ON a.page = b.page AND abs(a.y - b.y) = 1 AND a.x0 < b.x1 + 1 AND b.x0 < a.x1 + 1),
t AS (SELECT page, id AS root, id FROM k UNION SELECT t.page, t.root, e.v FROM t JOIN e ON t.page = e.page AND t.id = e.u),
l AS (SELECT page, id, min(root) AS root FROM t GROUP BY ALL)
SELECT page, min(x0) AS x, min(y) AS y, max(x1) - min(x0) AS w, max(y) - min(y) + 1 AS h, CAST(sum(ink) AS BIGINT) AS ink, count(DISTINCT y) AS rows, sum(ink) / ((max(x1) - min(x0)) * (max(y) - min(y) + 1)) AS density FROM k JOIN l USING (page, id) GROUP BY page, root""")
def px_components(spark, sf_dir):
    return P.components(_mask(spark, sf_dir))


@query(_PX + """, k AS (SELECT page, r // 16 AS kr, g // 16 AS kg, b // 16 AS kb, count(*) AS n, min(y * 2147483648 + x) AS f, sum(r) AS r, sum(g) AS g, sum(b) AS b FROM planes GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY n DESC, f) AS p, count(*) OVER (PARTITION BY page) AS u FROM k)
SELECT page, r / n AS r, g / n AS g, b / n AS b, n / 64 AS coverage, u AS "unique" FROM o WHERE p = 1""")
def px_dominant_colour(spark, sf_dir):
    return P.dominant_colour(D.planes(spark, sf_dir))


@query(_MASK + ", f AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM (SELECT page, y FROM mask GROUP BY page, y HAVING sum(ink) >= 0.5 * 8)) SELECT page, min(y) AS y0, max(y) + 1 AS y1 FROM f GROUP BY page, g HAVING max(y) + 1 - min(y) <= 6")
def px_structure_rows(spark, sf_dir):
    return P.structure_rows(_mask(spark, sf_dir), 8, 0.5)


@query(_PX + ", c AS (SELECT page, x, avg(CASE WHEN abs(lum - 120) > 38 THEN 1 ELSE 0 END) AS busy FROM planes WHERE x >= 3 GROUP BY ALL) SELECT page, min(x) FILTER (busy > 0.25) AS blocked_at FROM c GROUP BY page")
def px_free_right(spark, sf_dir):
    return P.free_right(D.planes(spark, sf_dir), 120, 3)


@query(_PX + " SELECT page, y // 2 AS y, x // 2 AS x, CAST(round_even(avg(255 - lum), 0) AS INTEGER) AS lum FROM planes GROUP BY page, y // 2, x // 2")
def px_invert_downscale(spark, sf_dir):
    return P.downscale(P.inverted(D.planes(spark, sf_dir))).select("page", F.col("y").cast("int"), F.col("x").cast("int"), "lum")


def _plane_rows(spark, sf_dir):
    """Planes as page images, each pixel drawn 8 x 8."""
    p = D.planes(spark, sf_dir).repartition(tasks(spark), "page").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "lum"))).alias("p"))
    line = lambda r: F.array_join(F.transform(F.slice("p", r * 8 + 1, 8), lambda q: F.repeat(F.lpad(F.hex(q["lum"]), 2, "0"), 8)), "")
    body = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.repeat(line(r), 8)), "")
    return p.select("page", F.lit(64).alias("width"), F.lit(64).alias("height"), F.unhex(body).alias("lum"))


@query()
def kernel_detect_lines(spark, sf_dir):
    return K.detect_pages(_plane_rows(spark, sf_dir))


@query()
def kernel_erase(spark, sf_dir):
    rows = _plane_rows(spark, sf_dir).select("page", "width", "height", F.unhex(F.regexp_replace(F.hex("lum"), "(..)", "$1$1$1")).alias("rgb"))
    return K.erase_pages(rows).select("page", F.md5("rgb").alias("digest"), "masked")


_EDGE = """lum_at AS (SELECT page, y, x, CAST(lum AS DOUBLE) AS lum FROM planes), off AS (SELECT unnest(range(-2, 3)) AS d),
bh AS (SELECT a.page, a.y, a.x, sum(b.lum) AS s FROM lum_at a, off, lum_at b WHERE b.page = a.page AND b.y = a.y AND b.x = least(greatest(a.x + d, 0), 7) GROUP BY ALL),
blur AS (SELECT a.page, a.y, a.x, sum(b.s) / 25 AS blur FROM bh a, off, bh b WHERE b.page = a.page AND b.x = a.x AND b.y = least(greatest(a.y + d, 0), 7) GROUP BY ALL)"""


@query(_PX + f", {_EDGE} SELECT page, y, x, blur FROM blur")
def px_box_blur(spark, sf_dir):
    return P.box_blur(D.planes(spark, sf_dir), 2).select("page", "y", "x", "blur")


@query(_PX + f""", {_EDGE}, l AS (SELECT page, lag(lum) OVER a + lead(lum) OVER a + lag(lum) OVER d + lead(lum) OVER d - 4 * lum AS l FROM planes WINDOW a AS (PARTITION BY page, y ORDER BY x), d AS (PARTITION BY page, x ORDER BY y)),
v AS (SELECT page, coalesce(var_pop(l), 0) AS v FROM l GROUP BY page), am AS (SELECT page, CAST(CASE WHEN v / (v + 500) < 0.35 THEN 0.9 WHEN v / (v + 500) < 0.6 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS amount FROM v)
SELECT page, y, x, CASE WHEN abs(lum - blur) < 3 THEN lum ELSE CAST(least(greatest(round_even(lum + amount * (lum - blur), 0), 0), 255) AS INTEGER) END AS sharp FROM planes JOIN blur USING (page, y, x) JOIN am USING (page)""")
def px_sharpen_for_reading(spark, sf_dir):
    p = D.planes(spark, sf_dir)
    return P.unsharp(p.join(P.sharpening(p), "page"), F.col("amount"), 2, 3.0).select("page", "y", "x", "sharp")


@query(SQL["px_otsu"].replace("SELECT page, CAST(CASE WHEN b > 0", ", t AS (SELECT page, CAST(CASE WHEN b > 0", 1).replace("WHERE k = 1", "WHERE k = 1)", 1) + """,
e AS (SELECT page, y, x, CASE WHEN avg(CASE WHEN (y * 8 + x) % 4 = 0 THEN CASE WHEN lum <= threshold THEN 1.0 ELSE 0.0 END END) OVER (PARTITION BY page) > 0.6 THEN 255 - lum ELSE lum END AS lum FROM planes JOIN t USING (page)),
g AS (SELECT a.page, a.y, a.x, any_value(a.lum) AS lum, avg(b.lum) FILTER (abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1) AS fine, avg(b.lum) FILTER (abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3) AS coarse FROM e a JOIN e b USING (page) GROUP BY ALL)
SELECT page, y, x, CAST(lum < fine - 10 OR lum < coarse - 10 AS INTEGER) AS ink FROM g""")
def px_detection_ink(spark, sf_dir):
    return P.detection_ink(D.planes(spark, sf_dir), 1, 3)


@query(_PX + """, m AS (SELECT page, list_sort(list(r))[33] AS mr, list_sort(list(g))[33] AS mg, list_sort(list(b))[33] AS mb FROM planes GROUP BY page)
SELECT page, any_value(mr) AS r, any_value(mg) AS g, any_value(mb) AS b, avg(abs(planes.r - mr) + abs(planes.g - mg) + abs(planes.b - mb)) / 3 AS spread FROM planes JOIN m USING (page) GROUP BY page""")
def px_median_colour(spark, sf_dir):
    return P.median_colour(D.planes(spark, sf_dir))


@query(_PX + " SELECT page, y, x, lum FROM planes WHERE x BETWEEN 1 AND 6 AND y BETWEEN 2 AND 7 AND NOT (x BETWEEN 3 AND 4 AND y BETWEEN 4 AND 5)")
def px_ring(spark, sf_dir):
    return P.ring(D.planes(spark, sf_dir), (3, 4, 2, 2)).select("page", "y", "x", "lum")


@query(_PX + """, l AS (SELECT page, y, x, 0.299 * CAST(r AS DOUBLE) + 0.587 * CAST(g AS DOUBLE) + 0.114 * CAST(b AS DOUBLE) AS l FROM planes), k AS (SELECT page, CAST(quantile_disc(CAST(floor(l) AS INTEGER), 0.5) AS INTEGER) AS background FROM l GROUP BY page),
w AS (SELECT page, y, count(*) AS ink, min(x) AS x0, max(x) AS x1 FROM l JOIN k USING (page) WHERE abs(l - background) > 38 GROUP BY ALL), i AS (SELECT *, y - row_number() OVER (PARTITION BY page ORDER BY y) AS g FROM w),
b AS (SELECT page, min(y) AS y0, max(y) + 1 AS y1, min(x0) AS x0, max(x1) AS x1, sum(ink) AS ink FROM i GROUP BY page, g)
SELECT page, min(x0) AS x, min(y0) AS y, max(x1) - min(x0) + 1 AS w, max(y1) - min(y0) AS h, CAST(sum(ink) AS DOUBLE) / ((max(x1) - min(x0) + 1) * (max(y1) - min(y0))) AS density, background, background < 95 AS dark,
  CASE WHEN count(*) FILTER (y1 - y0 >= 2) > 1 THEN CAST(count(*) FILTER (y1 - y0 >= 2) AS INTEGER) ELSE 1 END AS line_count FROM b JOIN k USING (page) GROUP BY page, background""")
def px_measure_ink(spark, sf_dir):
    return P.measure_ink(D.planes(spark, sf_dir)).select("page", "x", "y", "w", "h", "density", "background", "dark", "line_count")


@query()
def px_ink_alignment(spark, sf_dir):
    return P.measure_ink(D.planes(spark, sf_dir), 20.0).select("page", "line_height", "alignment")


@query(f"""WITH {D.BOXES}, r AS (SELECT page, no, greatest(0, floor((x - 1) * 1.5)) AS x, greatest(0, floor((y - 1) * 1.5)) AS y, least({PAGE_W}, ceil((x + w + 1) * 1.5)) AS x1, least({PAGE_H}, ceil((y + h + 1) * 1.5)) AS y1,
  floor(least(greatest(least(w, h) * 20 * CAST(0.025 AS DOUBLE), 24), 200) + 0.5) AS fw, floor(least(25, greatest(3, floor(h * CAST(0.6 AS DOUBLE) + 0.5))) + 0.5) AS d FROM boxes)
SELECT page, no, x, y, greatest(1, x1 - x) AS w, greatest(1, y1 - y) AS h, CAST(fw AS DOUBLE) AS fallback_w, CAST(greatest(12, floor(fw * 0.5 + 0.5)) AS DOUBLE) AS fallback_h, CAST(CASE WHEN d % 2 = 0 THEN d + 1 ELSE d END AS DOUBLE) AS brush FROM r""")
def box_map_rect(spark, sf_dir):
    m = G.map_rect(G.Box.of(), 1.5, 1.0, PAGE_W, PAGE_H)
    fw, fh = G.fallback_size(F.col("w") * 20, F.col("h") * 20)
    return D.boxes(spark, sf_dir).select("page", "no", *[c.cast("double").alias(n) for n, c in zip("xywh", m, strict=True)], fw.cast("double").alias("fallback_w"), fh.cast("double").alias("fallback_h"), G.dilation_width(F.col("h")).cast("double").alias("brush"))


@query(f"""WITH {D.BOXES}, p AS (SELECT page, no, w * 40 AS pw, h * 120 AS ph FROM boxes), n AS (SELECT *, CAST(greatest(1, ceil(pw / 1376)) AS BIGINT) AS nc, CAST(greatest(1, ceil(ph / 1376)) AS BIGINT) AS nr FROM p),
s AS (SELECT *, ceil(pw / nc) AS tw, ceil(ph / nr) AS th, floor(least(ceil(pw / nc), ceil(ph / nr)) * CAST(0.12 AS DOUBLE) + 0.5) AS lap FROM n), c AS (SELECT *, unnest(range(nc)) AS c FROM s), r AS (SELECT *, unnest(range(nr)) AS r FROM c),
t AS (SELECT page, no, nc, nr, greatest(0, c * tw - CASE WHEN c > 0 THEN lap ELSE 0 END) AS x, greatest(0, r * th - CASE WHEN r > 0 THEN lap ELSE 0 END) AS y, least(pw, (c + 1) * tw + CASE WHEN c < nc - 1 THEN lap ELSE 0 END) AS x1, least(ph, (r + 1) * th + CASE WHEN r < nr - 1 THEN lap ELSE 0 END) AS y1 FROM r)
SELECT page, no, x, y, x1 - x AS w, y1 - y AS h FROM t WHERE (nc = 1 AND nr = 1) OR (x1 - x >= 32 AND y1 - y >= 32)""")
def page_tiles(spark, sf_dir):
    return D.boxes(spark, sf_dir).select("page", "no", F.explode(G.tiles(F.col("w") * 40, F.col("h") * 120)).alias("t")).select("page", "no", "t.*")


@query()
def tiles_drop_repeats(spark, sf_dir):
    return B.drop_repeats(D.boxes(spark, sf_dir))


@query()
def ocr_drop_reread(spark, sf_dir):
    conf = (F.col("no") * 37 % 100).cast("double").alias("conf")
    return B.drop_reread(D.boxes(spark, sf_dir).select("page", "no", "x", "y", "w", "h", F.col("src").alias("text"), conf))


@query()
def regions_from_lines(spark, sf_dir):
    return B.group_regions(D.boxes(spark, sf_dir).withColumn("ink", F.floor(F.col("w") * F.col("h") * 0.3)))


@query(_ADDRESSES_SQL + r""", b AS (SELECT k, status, u, regexp_replace(u, '/chat/completions$', '') AS b FROM s)
SELECT k, CASE WHEN u LIKE '%/models' THEN u WHEN b = 'https://api.deepseek.com' OR regexp_matches(b, '/v[0-9]+[a-z0-9]*$') THEN b || '/models' ELSE b || '/v1/models' END AS endpoint,
  CAST(CASE WHEN k % 2 = 1 THEN least(10000, status % 20 * 1000) ELSE least(10000, 500 * pow(2, k % 6)) END AS DOUBLE) AS wait_ms FROM b""")
def endpoint_models_and_waits(spark, sf_dir):
    asked = F.when(F.col("k") % 2 == 1, F.col("status") % 20)
    return _addresses(spark, sf_dir).select("k", T.models_endpoint(F.col("url")).alias("endpoint"), T.backoff_ms(F.col("k") % 6, asked).cast("double").alias("wait_ms"))


@query(_TEXT + " SELECT k, no, 'zh-CN' || chr(1) || CASE WHEN no % 2 = 0 THEN 'llm' ELSE 'free' END || chr(1) || CASE WHEN no % 2 = 0 THEN 'm@u' ELSE '' END || chr(1) || '0' || chr(1) || CASE WHEN no % 3 = 0 THEN '1' ELSE '0' END || chr(1) || line AS key FROM t")
def translate_cache_key(spark, sf_dir):
    engine = F.when(F.col("no") % 2 == 0, "llm").otherwise("free")
    return _text(spark, sf_dir).select("k", "no", T.cache_key(F.col("line"), F.lit("zh-CN"), engine, F.lit("m@u"), F.lit("0"), F.col("no") % 3 == 0).alias("key"))


@query("""SELECT p_partkey AS k, u.slot, CASE u.slot WHEN 0 THEN 'A' || p_size WHEN 1 THEN 'B' || p_size WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'C' END END AS answer
FROM part, (SELECT unnest(range(3))::INTEGER AS slot) u""")
def json_batch_answers(spark, sf_dir):
    s = F.col("p_size").cast("string")
    last = F.when(F.col("p_size") % 2 == 0, F.lit(', {"id": 9, "dst": "C"}')).otherwise(F.lit(', {"id": 2, "text": "echo"}'))
    body = F.concat(F.lit('```json\n{"items": [{"id": 1, "translation": "B'), s, F.lit('"}, {"index": "0", "zh": "A'), s, F.lit('"}'), last, F.lit(",]}\n```"))
    return J.batch_answers(D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), body.alias("body"), F.lit(3).alias("n"))).select("k", "slot", "answer")


@query(f"""WITH {D.BOXES} SELECT page, 0 AS line_no, x, y, w, h, src AS text, CASE WHEN no % 2 = 0 THEN CAST(no AS DOUBLE) ELSE 100.0 END AS conf FROM boxes WHERE no % 3 <> 2
UNION ALL SELECT page, 0, x, y, w + 10, h, src || ' next', 55.0 FROM boxes WHERE no % 3 = 2""")
def ocr_lines_of_tree(spark, sf_dir):
    b = D.boxes(spark, sf_dir)
    at = lambda more: F.struct(F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("x") + F.col("w") + more).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    line = F.struct(F.concat(F.lit("  "), F.regexp_replace("src", " ", "\n ")).alias("text"), F.when(F.col("no") % 2 == 0, F.col("no").cast("double")).alias("confidence"), at(0).alias("bbox"))
    word = lambda t, c, more: F.struct(t.alias("text"), F.lit(c).alias("confidence"), at(more).alias("bbox"))
    flat = F.to_json(F.struct(F.array(line).alias("lines")))
    deep = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(line).alias("lines"))).alias("paragraphs"))).alias("blocks")))
    words = F.to_json(F.struct(F.array(word(F.col("src"), 50.0, 0), word(F.lit("next"), 60.0, 10)).alias("words")))
    return O.lines_of_tree(b.select("page", F.when(F.col("no") % 3 == 0, flat).when(F.col("no") % 3 == 1, deep).otherwise(words).alias("body"))).select("page", "line_no", "x", "y", "w", "h", "text", "conf")


def fake_reader(image: bytes, crop: dict, kind: str) -> str:
    """Says where it looked; fails on some crops and babbles on others, by the crop's place."""
    if kind == "region" and int(crop["x"]) % 5 == 0:
        raise ConnectionError("busy")
    if kind == "region" and int(crop["y"]) % 11 == 3:
        return "no braces here"
    return '{"items": [{"text": "%s %d", "translation": "t", "box": [100, 100, 900, 900]}]}' % (kind, int(crop["y"]) % 3)


def _answers(spark, sf_dir):
    b = D.boxes(spark, sf_dir)
    pages = b.groupBy("page").agg(F.lit(PAGE_W).alias("width"), F.lit(PAGE_H).alias("height"), F.lit(b"\0").alias("image"))
    return R.ask(pages, R.requests(pages, b), fake_reader)


@query(f"""WITH {D.BOXES}, r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY w * h DESC, no) AS rank FROM boxes WHERE w >= 8 AND h >= 6),
p AS (SELECT page, rank, greatest(0, x - greatest(4, floor(greatest(w, h) * CAST(0.12 AS DOUBLE) + 0.5))) AS cx, greatest(0, y - greatest(4, floor(greatest(w, h) * CAST(0.12 AS DOUBLE) + 0.5))) AS cy FROM r WHERE rank <= 24),
q AS (SELECT page, count(*) AS regions, count(*) FILTER (CAST(floor(cx) AS BIGINT) % 5 = 0 OR CAST(floor(cy) AS BIGINT) % 11 = 3) AS failed FROM p GROUP BY page)
SELECT page, regions + 1 AS requests, failed, regions, failed < regions AS usable FROM q""")
def reading_two_pass_report(spark, sf_dir):
    answers = _answers(spark, sf_dir)
    return R.reading_report(answers, R.read_items(answers)).select("page", "requests", "failed", "regions", "usable")


@query()
def reading_two_pass_items(spark, sf_dir):
    return R.read_items(_answers(spark, sf_dir)).select("page", "pos", "x", "y", "w", "h", "src", "dst")


@query()
def kernel_cover_boxes(spark, sf_dir):
    pages = _plane_rows(spark, sf_dir).select("page", "width", "height", F.unhex(F.regexp_replace(F.hex("lum"), "(..)", "$1$1$1")).alias("rgb"))
    todo = pages.select("page", F.explode(F.array(*[F.struct(F.lit(i).alias("no"), *[F.lit(float(v)).alias(c) for c, v in zip("xywh", b, strict=True)]) for i, b in enumerate(((4, 4, 24, 20), (30, 30, 20, 28)))])).alias("b")).select("page", "b.*")
    return K.cover_pages(pages, todo).select("page", F.md5("rgb").alias("digest"), F.explode("report").alias("r")).select("page", "digest", "r.*")


from . import more, printed, remembered, services, tiled  # noqa: E402, F401  (registers further queries with the two tables above)
from .oracles import MORE  # noqa: E402

SQL |= MORE
