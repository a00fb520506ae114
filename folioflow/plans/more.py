"""Queries of the render chain, service rules, resampling, tiled detection and recognition from end to end."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import service as S
from ..functions import text as T
from ..operators import boxes as B
from ..operators import glossary as L
from ..operators import kernels as K
from ..operators import recognition as N
from ..operators import render as R
from ..operators.pages import in_slices
from ..sources import derive as D
from .queries import _CODES_SQL, _HAN, _PX, _TEXT, GLOSSARY, PAGE_H, PAGE_W, SQL, _plane_rows, _text, glossary_parse, query

# Render chain ---------------------------------------------------------------------------------------------------------

_ITEMS = f"""WITH {D.BOXES}, items AS (SELECT page, no, x, y, w, CASE WHEN no = 6 THEN 0 ELSE h END AS h, CASE WHEN no % 4 = 0 THEN dst ELSE src END AS src, dst FROM boxes)"""
_INK = f"""WITH {D.BOXES}, i AS (SELECT page, no, h, h - 2 AS ih, CAST(CASE WHEN no % 5 = 0 THEN h * 3 WHEN no % 7 = 3 THEN 2 ELSE h * 0.7 END AS DOUBLE) AS lh, CAST(1 + no % 2 AS INTEGER) AS n FROM boxes),
a AS (SELECT *, ih / n AS mean FROM i), b AS (SELECT page, no, h, ih, CASE WHEN lh > 1.45 * mean OR lh < 0.55 * mean THEN mean ELSE lh END AS lh,
  CASE WHEN lh > 1.45 * mean OR lh < 0.55 * mean THEN greatest(1, CAST(floor(ih / greatest(4.0, mean) + 0.5) AS INTEGER)) ELSE n END AS n FROM a),
m AS (SELECT page, list_sort(list(lh))[len(list(lh)) // 2 + 1] AS median_h FROM b GROUP BY page),
e AS (SELECT page, no, h, ih, median_h, median_h > 4 AND (lh / median_h >= 1.8 OR lh / median_h <= 0.45) AS far, lh, n FROM b JOIN m USING (page)),
ink AS (SELECT page, no, h, ih, median_h, CASE WHEN far THEN median_h ELSE lh END AS line_height, CASE WHEN far THEN greatest(1, CAST(floor(ih / median_h + 0.5) AS INTEGER)) ELSE n END AS line_count FROM e)"""


def _items(spark, sf_dir) -> DataFrame:
    b = D.boxes(spark, sf_dir)
    src = F.when(F.col("no") % 4 == 0, F.col("dst")).otherwise(F.col("src"))
    return b.withColumn("h", F.when(F.col("no") == 6, 0.0).otherwise(F.col("h"))).withColumn("src", src)


def _inked(boxes: DataFrame) -> DataFrame:
    """Boxes with a made-up measure of their ink: some line heights glued from several lines, some far too small."""
    h, no = F.col("h"), F.col("no")
    high = F.when(no % 5 == 0, h * 3).when(no % 7 == 3, F.lit(2.0)).otherwise(h * 0.7)
    align = F.element_at(F.array(*map(F.lit, ("left", "center", "right"))), no % 3 + 1)
    parts = ((F.col("x") + 2, "x"), (F.col("y") + 1, "y"), (F.col("w") - 4, "w"), (h - 2, "h"), (high, "line_height"), ((1 + no % 2).cast("int"), "line_count"), (align, "alignment"))
    return boxes.withColumn("ink", F.struct(*[c.alias(k) for c, k in parts]))


@query(_ITEMS + " SELECT page, no, CASE WHEN dst = '' THEN 'empty' WHEN dst = src THEN 'same' WHEN NOT (w > 0 AND h > 0) THEN 'failed' END AS fate FROM items")
def render_work_filter(spark, sf_dir):
    return _items(spark, sf_dir).select("page", "no", R.fate(*(F.col(c) for c in ("dst", "src", "w", "h"))).alias("fate"))


@query(_INK + " SELECT page, no, median_h, line_height, line_count FROM ink")
def render_even_ink(spark, sf_dir):
    return R.even_ink(_inked(D.boxes(spark, sf_dir))).select("page", "no", "median_h", "ink.line_height", "ink.line_count")


@query(_INK + """, s AS (SELECT *, CASE WHEN no % 4 = 1 THEN h ELSE line_height / 0.72 END * CAST(1.35 AS DOUBLE) AS em, median_h * CAST(1.35 AS DOUBLE) AS page_em FROM ink),
t AS (SELECT *, least(em, greatest(ih * CAST(1.15 AS DOUBLE), 11)) AS own, greatest(em, page_em * CAST(1.2 AS DOUBLE)) AS high, greatest(11, least(em, page_em * CAST(0.75 AS DOUBLE))) AS low FROM s)
SELECT page, no, CASE WHEN median_h <= 4 THEN own WHEN own < low THEN low WHEN own > high THEN high ELSE own END AS size_cap FROM t""")
def render_size_cap(spark, sf_dir):
    items = R.even_ink(_inked(D.boxes(spark, sf_dir)))
    font = F.when(F.col("no") % 4 == 1, F.col("h"))
    return items.select("page", "no", R.size_cap(F.col("ink.h"), font, F.col("ink.line_height"), F.col("median_h")).alias("size_cap"))


def _render_plan(spark, sf_dir) -> DataFrame:
    items = _inked(_items(spark, sf_dir)).withColumn("engine", F.when(F.col("no") % 2 == 0, "vision").otherwise("llm")).withColumn("free", F.lit(30.0))
    items = items.withColumn("font_height", F.when(F.col("no") % 4 == 1, F.col("h")))
    drawn = items.where(R.fate(*(F.col(c) for c in ("dst", "src", "w", "h"))).isNull())
    return R.render_plan(items, B.neighbour_limits(drawn.select("page", "no", "x", "y", "w", "h"), PAGE_W, PAGE_H))


@query()
def render_plan(spark, sf_dir):
    plan = _render_plan(spark, sf_dir)
    cover = [F.round(f"place.cover.{c}", 6).alias(f"cover_{c}") for c in "xywh"]
    return plan.where("fate IS NULL").select("page", "no", "place.layout.font_size", F.size("place.layout.lines").alias("lines"), F.round("place.draw_x", 6).alias("draw_x"), *cover, "place.relayout")


@query(_ITEMS + """, f AS (SELECT page, CASE WHEN dst = '' THEN 'empty' WHEN dst = src THEN 'same' WHEN NOT (w > 0 AND h > 0) THEN 'failed' END AS fate FROM items)
SELECT page, count(*) AS total, count(*) FILTER (fate IS NULL) AS drawn, count(*) FILTER (fate = 'empty') AS skipped_empty, count(*) FILTER (fate = 'same') AS skipped_same, count(*) FILTER (fate = 'failed') AS failed FROM f GROUP BY page""")
def render_statistics(spark, sf_dir):
    return R.render_statistics(_render_plan(spark, sf_dir)).select("page", "total", "drawn", "skipped_empty", "skipped_same", "failed")


@query(_TEXT + r""", s AS (SELECT k, no, trim(line) AS s FROM t), c AS (SELECT *, len(regexp_extract_all(s, '[A-Za-z]')) + len(regexp_extract_all(s, '[\x{4e00}-\x{9fff}]')) AS n FROM s),
f AS (SELECT *, CASE WHEN s = '' THEN 'normal' WHEN regexp_matches(s, '(?i)^(PMS|SKU|ITEM|ART|MODEL)\b') OR regexp_matches(s, '(?i)^[\d\s.,%''"/x×\-+]+$') OR regexp_matches(s, '(?i)^[\d.,]+\s*(in|inch|cm|mm|m|ft|kg|g|oz|lb|pcs?|%)$') THEN 'code'
  WHEN n >= 22 OR regexp_matches(s, '[.。;；]') THEN 'note' WHEN regexp_matches(s, '^[A-Z0-9\s/&.\-]{2,}$') OR n <= 14 THEN 'label' ELSE 'normal' END AS kind FROM c)
SELECT k, no, CASE WHEN no % 5 = 0 THEN '1,2,3' WHEN kind = 'label' THEN '26,79,138' WHEN kind = 'code' THEN '138,26,92' WHEN kind = 'note' THEN '31,111,58' ELSE '1,2,3' END AS colour FROM f""")
def field_colours(spark, sf_dir):
    sampled = F.array(F.lit(1), F.lit(2), F.lit(3))
    colour = R.field_colour(F.col("line"), sampled, F.col("no") % 5 == 0)
    return _text(spark, sf_dir).select("k", "no", F.array_join(colour.cast("array<string>"), ",").alias("colour"))


# Services -------------------------------------------------------------------------------------------------------------

#: Addresses as people write them, the protocol, and where requests and the list of models of each then go.
ADDRESSES = (
    ("https://generativelanguage.googleapis.com", "gemini", "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "https://generativelanguage.googleapis.com/v1beta/models"),
    ("https://g.example/v1beta/models/gemini-2.5-flash:generateContent?alt=sse", "gemini", "https://g.example/v1beta/models/{model}:generateContent", "https://g.example/v1beta/models"),
    ("g.example/v1/", "gemini", "https://g.example/v1beta/models/{model}:generateContent", "https://g.example/v1beta/models"),
    ("", "gemini", "https://generativelanguage.googleapis.com/v1beta/models/{model}:generateContent", "https://generativelanguage.googleapis.com/v1beta/models"),
    ("", "openai", "https://api.openai.com/v1/chat/completions", "https://api.openai.com/v1/models"),
    ("https://a.example/compatible-mode/v1", "openai", "https://a.example/compatible-mode/v1/chat/completions", "https://a.example/compatible-mode/v1/models"),
    ("https://a.example/api/paas/v4/", "openai", "https://a.example/api/paas/v4/chat/completions", "https://a.example/api/paas/v4/models"),
    ("https://a.example/v1/chat/completions#x", "openai", "https://a.example/v1/chat/completions", "https://a.example/v1/models"),
    ("a.example", "openai", "https://a.example/v1/chat/completions", "https://a.example/v1/models"),
    ("https://a.example/v1/models", "openai", "https://a.example/v1/chat/completions", "https://a.example/v1/models"),
)
#: A sign stands for a number.
MODELS = (("", "gemini", "gemini-2.5-flash"), ("models/gemini-#", "gemini", "gemini-#"), ("https://g.example/v1beta/models/gemini-x#?key=1", "gemini", "gemini-x#"), (" /qwen-# ", "openai", "qwen-#"), ("org/model#", "openai", "org/model#"))


def _values(rows) -> str:
    quoted = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)


_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"


@query(f"""SELECT page_id AS k, replace(replace(chat, 'a.example', {_HOST_SQL}), 'g.example', {_HOST_SQL}) AS chat, replace(replace(models, 'a.example', {_HOST_SQL}), 'g.example', {_HOST_SQL}) AS models
FROM pages JOIN (VALUES {_values((i, chat, listed) for i, (_, _, chat, listed) in enumerate(ADDRESSES))}) AS t(i, chat, models) ON page_id % {len(ADDRESSES)} = i""")
def service_endpoints(spark, sf_dir):
    """Addresses in all the ways in which people write them, on the hosts of the pages."""
    form = lambda i: F.get(F.array(*[F.lit(a[i]) for a in ADDRESSES]), (F.col("page_id") % len(ADDRESSES)).cast("int"))
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1)
    given = F.replace(F.replace(form(0), F.lit("a.example"), host), F.lit("g.example"), host)
    rows = D.table(spark, sf_dir, "pages").select(F.col("page_id").alias("k"), given.alias("given"), form(1).alias("protocol"))
    at = lambda kind: S.service_endpoint(F.col("given"), F.lit(kind), F.col("protocol"))
    return rows.select("k", at("chat").alias("chat"), at("models").alias("models"))


@query(f"""SELECT k, model, CASE WHEN protocol = 'gemini' THEN 'https://g.example/v1beta/models/' || model || ':generateContent?key=a%2Fb' ELSE 'https://g.example/v1beta/models/' || replace(model, '/', '%2F') || ':generateContent' END AS address
FROM (SELECT p_partkey AS k, protocol, replace(model, '#', CAST(p_partkey AS VARCHAR)) AS model FROM part JOIN (VALUES {_values((i, p, m) for i, (_, p, m) in enumerate(MODELS))}) AS t(i, protocol, model) ON p_partkey % {len(MODELS)} = i)""")
def service_models(spark, sf_dir):
    """Models named after the parts, in all the ways in which people write them."""
    form = lambda i: F.replace(F.get(F.array(*[F.lit(m[i]) for m in MODELS]), (F.col("p_partkey") % len(MODELS)).cast("int")), F.lit("#"), F.col("p_partkey").cast("string"))
    rows = D.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), form(1).alias("protocol"), form(0).alias("given"))
    rows = rows.withColumn("model", S.model_name(F.col("given"), F.col("protocol")))
    at = S.service_endpoint(F.lit("g.example"), F.lit("chat"), F.lit("gemini"))
    return rows.select("k", "model", S.resolved(at, F.col("model"), F.col("protocol"), F.lit("a/b")).alias("address"))


# Glossary and codes ---------------------------------------------------------------------------------------------------

@query(SQL["glossary_parse"].replace("SELECT brand, no, term, target, target = ''", "SELECT brand, no, term FROM (SELECT brand, no, term, target = ''", 1) + ") WHERE keep")
def glossary_keep_list(spark, sf_dir):
    return L.keep_list(glossary_parse(spark, sf_dir), "brand")


_FNV = """lower(to_base(list_reduce(flatten(list_transform(range(1, length({0}) + 1), lambda i: CASE WHEN unicode(substr({0}, i, 1)) < 65536 THEN [CAST(unicode(substr({0}, i, 1)) AS BIGINT)]
  ELSE [55296 + ((CAST(unicode(substr({0}, i, 1)) AS BIGINT) - 65536) >> 10), 56320 + ((CAST(unicode(substr({0}, i, 1)) AS BIGINT) - 65536) & 1023)] END)),
  lambda h, c: (xor(h, c) * 16777619) & 4294967295, CAST(2166136261 AS BIGINT)), 36))"""

SQL["text_fnv1a"] = _TEXT + f" SELECT k, no, {_FNV.format('line')} AS key FROM t"
SQL["glossary_prompt_blocks"] = SQL["glossary_parse"].replace("SELECT brand, no, term, target, target = ''", "SELECT brand, coalesce(string_agg(CASE WHEN NOT keep THEN term || ' => ' || target END, chr(10) ORDER BY no), '') AS map_block, coalesce(string_agg(CASE WHEN keep THEN term END, chr(10) ORDER BY no), '') AS keep_block FROM (SELECT brand, no, term, target, target = ''", 1) + ") GROUP BY brand"


@query(SQL["glossary_parse"].replace("SELECT brand, no, term, target, target = ''", f"SELECT brand, {_FNV.format('e')} AS fingerprint FROM (SELECT brand, string_agg(term || chr(2) || target || chr(2) || CASE WHEN keep THEN '1' ELSE '0' END, chr(3) ORDER BY no) AS e FROM (SELECT brand, no, term, target, target = ''", 1) + ") GROUP BY brand)")
def glossary_fingerprint(spark, sf_dir):
    return L.fingerprint(glossary_parse(spark, sf_dir), "brand")


def _replaced(column: str) -> str:
    """The glossary's terms put in one after another, twice each, as neighbours share a boundary."""
    for term, to, keep in GLOSSARY:
        for _ in range(0 if keep else 2):
            column = f"regexp_replace({column}, '(^|[^A-Za-z0-9_])(?i:{term})($|[^A-Za-z0-9_])', '\\1{to}\\2', 'g')"
    return column


SQL["glossary_apply_many"] = _TEXT + f" SELECT k, no, {_replaced('line')} AS replaced FROM t"
_PUNCT = r"trim(regexp_replace(regexp_replace(regexp_replace({0}, '\s+([，。；：！？、）】」』])', '\1', 'g'), '([（【「『])\s+', '\1', 'g'), '[ \t]{{2,}}', ' ', 'g'))"
SQL["translate_join_back"] = _TEXT + rf""", r AS (SELECT k, no, trim(line) AS raw FROM t), g AS (SELECT k, no, raw, {_replaced('raw')} AS put, regexp_replace(raw, '{_CODES_SQL}', '', 'g') AS masked FROM r),
w AS (SELECT *, CASE WHEN raw = '' THEN 'blank' WHEN len(regexp_extract_all(raw, '{_HAN}')) > len(regexp_extract_all(raw, '[A-Za-z]')) THEN 'han' WHEN put <> raw AND NOT regexp_matches(put, '[A-Za-z]') THEN 'glossary'
  WHEN NOT regexp_matches(masked, '[A-Za-z]') THEN 'codes' ELSE 'send' END AS route FROM g)
SELECT k, no, CASE route WHEN 'blank' THEN '' WHEN 'glossary' THEN put WHEN 'send' THEN {_PUNCT.format(_replaced("'[' || raw || ']'"))} ELSE raw END AS dst,
  CASE route WHEN 'send' THEN 'engine' WHEN 'glossary' THEN 'glossary' ELSE 'skip' END AS engine, '' AS warn FROM w"""


@query(_TEXT + f""", c AS (SELECT k, no, line, regexp_extract_all(line, '{_CODES_SQL}') AS codes FROM t), d AS (SELECT *, CASE no % 3 WHEN 0 THEN line WHEN 1 THEN '' ELSE line || '{T.OPEN}7' END AS said FROM c),
l AS (SELECT *, list_filter(codes, lambda x: NOT contains(said, x)) AS lost FROM d)
SELECT k, no, concat_ws('; ', CASE WHEN contains(said, '{T.OPEN}') THEN 'placeholder left' END, CASE WHEN len(lost) > 0 THEN 'lost: ' || array_to_string(lost, ', ') END) AS residue FROM l""")
def code_residue(spark, sf_dir):
    t = _text(spark, sf_dir).withColumn("p", T.protected(F.col("line")))
    said = F.when(F.col("no") % 3 == 0, F.col("line")).when(F.col("no") % 3 == 1, "").otherwise(F.concat("line", F.lit(f"{T.OPEN}7")))
    return t.select("k", "no", T.residue(said, F.col("p.codes")).alias("residue"))


# Resampling and recognition -------------------------------------------------------------------------------------------

def _resampled(spark, sf_dir, size: int) -> DataFrame:
    rows = D.planes(spark, sf_dir).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "lum"))).alias("p"))
    body = F.unhex(F.array_join(F.transform("p", lambda q: F.lpad(F.hex(q["lum"]), 2, "0")), ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            planes = np.stack([K.resize(np.frombuffer(raw, dtype=np.uint8).reshape(8, 8), size, size) for raw in b["lum"]])
            y, x = np.divmod(np.arange(size * size), size)
            yield pd.DataFrame({"page": np.repeat(b["page"].to_numpy(), size * size), "y": np.tile(y, len(b)), "x": np.tile(x, len(b)), "lum": planes.ravel()})

    return rows.select("page", body.alias("lum")).mapInPandas(run, "page long, y int, x int, lum int")


def _axis(a: str, n: int) -> str:
    at = f"greatest(0, least(7, CAST(floor(({a} + 0.5) * 8 / {n} - 0.5) AS INTEGER)))"
    return f"{at} AS {a}0, least(7, {at} + 1) AS {a}1, greatest(0, least(1, ({a} + 0.5) * (8 / {n}) - 0.5 - {at})) AS p{a}"


@query(_PX + f""", o AS (SELECT DISTINCT page, oy AS oy, ox AS ox FROM (SELECT DISTINCT page FROM planes), (SELECT unnest(range(12)) AS oy), (SELECT unnest(range(12)) AS ox)),
c AS (SELECT page, oy, ox, {_axis('oy', 12)}, {_axis('ox', 12)} FROM o),
v AS (SELECT c.*, a.lum AS a, b.lum AS b, d.lum AS d, e.lum AS e FROM c JOIN planes a ON a.page = c.page AND a.y = oy0 AND a.x = ox0 JOIN planes b ON b.page = c.page AND b.y = oy0 AND b.x = ox1
  JOIN planes d ON d.page = c.page AND d.y = oy1 AND d.x = ox0 JOIN planes e ON e.page = c.page AND e.y = oy1 AND e.x = ox1)
SELECT page, CAST(oy AS INTEGER) AS y, CAST(ox AS INTEGER) AS x, CAST(round_even((a + (b - a) * pox) + ((d + (e - d) * pox) - (a + (b - a) * pox)) * poy, 0) AS INTEGER) AS lum FROM v""")
def px_resize_up(spark, sf_dir):
    return _resampled(spark, sf_dir, 12)


@query(_PX + """, o AS (SELECT unnest(range(5)) AS i), w AS (SELECT i, CAST(floor(i * 8 / 5) AS INTEGER) AS lo, CAST(ceil((i + 1) * 8 / 5) AS INTEGER) AS hi FROM o)
SELECT page, CAST(a.i AS INTEGER) AS y, CAST(b.i AS INTEGER) AS x, CAST(round_even(avg(lum), 0) AS INTEGER) AS lum FROM planes JOIN w a ON y >= a.lo AND y < a.hi JOIN w b ON x >= b.lo AND x < b.hi GROUP BY page, a.i, b.i""")
def px_resize_down(spark, sf_dir):
    return _resampled(spark, sf_dir, 5)


@query()
def kernel_prepare_for_reading(spark, sf_dir):
    def measured(raw: bytes) -> tuple[int, int, int, int]:
        plane = np.frombuffer(raw, dtype=np.uint8).reshape(64, 64)
        gray, ink = K.prepare_for_reading(plane, 1.5), K.prepare_for_reading(plane, 9.0, binarise=True)
        return gray.shape[0], ink.shape[0], int(gray.sum()), int((ink == 0).sum())

    def work(part: pd.DataFrame) -> pd.DataFrame:
        rows = [(page, *measured(raw)) for page, raw in zip(part["page"], part["lum"], strict=True)]  # a page's large planes go before the next page's come
        return pd.DataFrame(rows, columns=["page", "side", "largest", "gray", "ink"])

    return in_slices(_plane_rows(spark, sf_dir).select("page", "lum"), "lum", work, "page long, side int, largest int, gray long, ink long")


@query()
def detect_tiles(spark, sf_dir):
    return N.detect_tiled(_plane_rows(spark, sf_dir), most=48.0)


def fake_band_reader(bands: list[dict]) -> list[dict | None]:
    """Reads a band as one line; says nothing to some, is unsure of the words of others and has them in its tree alone."""
    out = []
    for b in bands:
        n = (b["page"] + b["band"]) % 5
        w, h = int(b["w"] * b["zoom"]), int(b["h"] * b["zoom"])
        word = "\t".join(map(str, (5, 1, 1, 1, 1, 1, 0, 0, w, h, 20 if n == 1 else 90, f"Material {b['page'] % 9}")))
        tree = json.dumps({"lines": [{"text": f"Tree {b['page'] % 9}", "confidence": 80, "bbox": {"x0": 0, "y0": 0, "x1": w, "y1": h}}]})
        out.append(None if n == 4 else {"tsv": word, "tree": tree})
    return out


def _recognised(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    lines = D.boxes(spark, sf_dir)
    pages = lines.select("page").distinct().select("page", F.lit(int(PAGE_W)).alias("width"), F.lit(int(PAGE_H)).alias("height"))
    return N.recognise(pages, lines, fake_band_reader)


@query()
def recognise_lines(spark, sf_dir):
    return _recognised(spark, sf_dir)[0].select("page", "no", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h", "font_height")], "text", "conf")


@query()
def recognise_report(spark, sf_dir):
    return _recognised(spark, sf_dir)[1].select("page", "bands", "calls", "raw")
