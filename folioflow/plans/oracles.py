"""SQL of queries whose operators fold a page's rows one after another: recursive CTEs that carry the page's list from step to step."""

from __future__ import annotations

from ..sources import derive as D


def _ratio(a: str, b: str) -> str:
    """Overlap of two structs with x, y, w, h over the smaller area."""
    wide, high = (f"(least({a}.{p} + {a}.{s}, {b}.{p} + {b}.{s}) - greatest({a}.{p}, {b}.{p}))" for p, s in (("x", "w"), ("y", "h")))
    return f"(CASE WHEN {wide} > 0 AND {high} > 0 THEN {wide} * {high} / least({a}.w * {a}.h, {b}.w * {b}.h) ELSE 0 END)"


def _struct(of: str, keys: tuple[str, ...]) -> str:
    return "{" + ", ".join(f"'{k}': {of}.{k}" for k in keys) + "}"


def _fold(name: str, source: str, order: str, keys: tuple[str, ...], step: str) -> str:
    """CTEs that leave ``name`` (page, pos, keys): the rows of ``source`` put into a list in ``order``, one after another.

    ``step`` is the new list, in terms of the row ``o`` and the list ``f.kept``; ``ITEM`` in it stands for the row as a struct.
    """
    item = _struct("o", keys)
    return f"""{name}_o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY {order}) AS k FROM {source}),
{name}_f AS (SELECT page, k, [{item}] AS kept FROM {name}_o o WHERE k = 1
  UNION ALL SELECT f.page, o.k, {step.replace("ITEM", item)} FROM {name}_f f JOIN {name}_o o ON o.page = f.page AND o.k = f.k + 1),
{name}_l AS (SELECT page, kept FROM {name}_f QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1),
{name}_u AS (SELECT page, unnest(range(len(kept))) AS pos, unnest(kept) AS item FROM {name}_l),
{name} AS (SELECT page, CAST(pos AS INTEGER) AS pos, {", ".join(f"item.{k} AS {k}" for k in keys)} FROM {name}_u)"""


ITEM = ("no", "x", "y", "w", "h", "src", "dst")
_NEAR = "abs(o.x + o.w / 2 - b.x - b.w / 2) < greatest(o.w, b.w) * 0.35 AND abs(o.y + o.h / 2 - b.y - b.h / 2) < greatest(o.h, b.h) * 0.5"
_SPOT = f"list_position(list_transform(f.kept, lambda b: {_ratio('o', 'b')} > 0.55 OR ({_ratio('o', 'b')} > 0.3 AND {_NEAR})), true)"
_BETTER = "((o.dst <> '' AND b.dst = '') OR ((o.dst <> '') = (b.dst <> '') AND o.w * o.h > b.w * b.h))"
_SAME = """(o.{0} = b.{0} OR ((contains(o.{0}, b.{0}) OR contains(b.{0}, o.{0})) AND least(length(o.{0}), length(b.{0})) / greatest(length(o.{0}), length(b.{0})) >= 0.6)
  OR 1 - levenshtein(o.{0}, b.{0}) / greatest(length(o.{0}), length(b.{0})) >= 0.82)"""


def _replace(at: str, better: str) -> str:
    swapped = f"list_transform(f.kept, lambda b, i: CASE WHEN i = {at} AND {better} THEN ITEM ELSE b END)"
    return f"CASE WHEN coalesce({at}, 0) = 0 THEN list_append(f.kept, ITEM) ELSE {swapped} END"


def _unless(hit: str) -> str:
    return f"CASE WHEN len(list_filter(f.kept, lambda b: {hit})) > 0 THEN f.kept ELSE list_append(f.kept, ITEM) END"


def _dedupe(name: str, source: str) -> str:
    return _fold(name, source, "no", ITEM, _replace(_SPOT, _BETTER))


def _collapse(name: str, source: str) -> str:
    order = "-length(CASE WHEN dst <> '' THEN dst ELSE src END), w * h, no"
    return _fold(name, source, order, ITEM, _unless(f"{_ratio('o', 'b')} > 0.42"))


_PAIR = "list_transform(range(1, len(l) + 1), lambda i: list_transform(range(i + 1, len(l) + 1), lambda j: {'i': i, 'j': j}))"
_GAP = "(greatest(l[p.i].x, l[p.j].x) - least(l[p.i].x + l[p.i].w, l[p.j].x + l[p.j].w))"
_LOW, _HIGH = "least(l[p.i].h, l[p.j].h)", "greatest(l[p.i].h, l[p.j].h)"
_OVER = "(least(l[p.i].y + l[p.i].h, l[p.j].y + l[p.j].h) - greatest(l[p.i].y, l[p.j].y))"


def _merge(name: str, source: str) -> str:
    """The first pair of a page's list that fits is merged, up to eight times; the list stays in order of y, x and place."""
    fits = f"{_LOW} > 0 AND {_OVER} >= CAST(0.55 AS DOUBLE) * {_LOW} AND {_HIGH} <= CAST(1.8 AS DOUBLE) * {_LOW} AND {_GAP} <= CAST(1.2 AS DOUBLE) * {_HIGH} AND {_GAP} >= CAST(-0.35 AS DOUBLE) * {_HIGH}"
    joined = """{'y': least(a.y, b.y), 'x': least(a.x, b.x), 'ord': hit.i, 'no': l[hit.i].no, 'w': greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x),
    'h': greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y), 'src': a.src || ' ' || b.src, 'dst': a.dst || CASE WHEN a.dst = '' OR b.dst = '' THEN '' ELSE ' ' END || b.dst,
    'merged': l[hit.i].merged + l[hit.j].merged + 1}"""
    placed = "{'y': e.y, 'x': e.x, 'ord': i, 'no': e.no, 'w': e.w, 'h': e.h, 'src': e.src, 'dst': e.dst, 'merged': e.merged}"
    return f"""{name}_m AS (SELECT page, 0 AS k, list_sort(list({{'y': y, 'x': x, 'ord': CAST(no AS BIGINT), 'no': no, 'w': w, 'h': h, 'src': src, 'dst': dst, 'merged': 0}})) AS l FROM {source} GROUP BY page
  UNION ALL SELECT page, k + 1, list_sort(list_filter(list_transform(l, lambda e, i: CASE WHEN i = hit.i THEN {joined} ELSE {placed} END), lambda e: e.ord <> hit.j))
  FROM (SELECT *, CASE WHEN l[hit.j].x < l[hit.i].x THEN l[hit.j] ELSE l[hit.i] END AS a, CASE WHEN l[hit.j].x < l[hit.i].x THEN l[hit.i] ELSE l[hit.j] END AS b
    FROM (SELECT *, list_filter(flatten({_PAIR}), lambda p: {fits})[1] AS hit FROM {name}_m)) WHERE hit IS NOT NULL AND k < 8),
{name}_l AS (SELECT page, l FROM {name}_m QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1),
{name} AS (SELECT page, e.no AS no, e.x AS x, e.y AS y, e.w AS w, e.h AS h, e.src AS src, e.dst AS dst, e.merged AS merged FROM (SELECT page, unnest(l) AS e FROM {name}_l))"""


def _hull(a: str, b: str, more: str) -> str:
    return f"{{'y': least({a}.y, {b}.y), 'x': least({a}.x, {b}.x), 'no': {a}.no, 'w': greatest({a}.x + {a}.w, {b}.x + {b}.w) - least({a}.x, {b}.x), 'h': greatest({a}.y + {a}.h, {b}.y + {b}.h) - least({a}.y, {b}.y), {more}}}"


_LINE = "greatest(1.0, least(hull.h, b.h))"
_X, _Y = "(least(hull.x + hull.w, b.x + b.w) - greatest(hull.x, b.x))", "(least(hull.y + hull.h, b.y + b.h) - greatest(hull.y, b.y))"
_JOINS = f"(({_Y} > 0.5 * {_LINE} AND -{_X} <= 40) OR ({_X} > -0.35 * {_LINE} AND -{_Y} <= 14 AND abs(b.x - hull.x) < greatest(0.35 * {_LINE} * 4, 60)))"
#: Blocks: a seed's hull scans what is left, again and again while it takes something in; each step looks at one box.
_BLOCKS = f"""s AS (SELECT page, list_sort(list({{'y': y, 'x': x, 'no': no, 'w': w, 'h': h, 'ink': ink, 'n': 1}})) AS l FROM source WHERE w > 0 AND h > 0 GROUP BY page),
g AS (SELECT page, 0 AS k, l[1] AS hull, l[2:] AS todo, l[1:0] AS rest, false AS grown, l[1:0] AS done, false AS ended FROM s
  UNION ALL SELECT page, k + 1,
    CASE WHEN len(todo) > 0 THEN CASE WHEN joins THEN {_hull('hull', 'b', "'ink': hull.ink + b.ink, 'n': hull.n + 1")} ELSE hull END WHEN again THEN hull ELSE rest[1] END,
    CASE WHEN len(todo) > 0 THEN todo[2:] WHEN again THEN rest ELSE rest[2:] END,
    CASE WHEN len(todo) > 0 THEN CASE WHEN joins THEN rest ELSE list_append(rest, b) END ELSE rest[1:0] END,
    CASE WHEN len(todo) > 0 THEN grown OR joins ELSE false END,
    CASE WHEN len(todo) > 0 OR again THEN done ELSE list_append(done, hull) END,
    len(todo) = 0 AND NOT again AND len(rest) = 0
  FROM (SELECT *, len(todo) = 0 AND grown AND len(rest) > 0 AS again, coalesce({_JOINS}, false) AS joins FROM (SELECT *, todo[1] AS b FROM g WHERE NOT ended))),
d AS (SELECT page, unnest(range(len(done))) AS block, unnest(done) AS e FROM g WHERE ended)"""
_BOXES = f"WITH RECURSIVE {D.BOXES}"

#: Bands: lines from the top join the last band while their height and distance fit; a page here never has too many.
_BANDS = """r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y, x, w, h) AS k FROM boxes),
b AS (SELECT page, k, [{'x': x, 'y': y, 'x1': x + w, 'y1': y + h, 'hs': [h]}] AS bands FROM r WHERE k = 1
  UNION ALL SELECT b.page, r.k, CASE WHEN abs(r.h - med) <= greatest(3, 0.5 * med) AND r.y - last.y1 <= greatest(10, 2.5 * med) AND len(last.hs) < 12
    THEN list_append(bands[1:-2], {'x': least(last.x, r.x), 'y': least(last.y, r.y), 'x1': greatest(last.x1, r.x + r.w), 'y1': greatest(last.y1, r.y + r.h), 'hs': list_append(last.hs, r.h)})
    ELSE list_append(bands, {'x': r.x, 'y': r.y, 'x1': r.x + r.w, 'y1': r.y + r.h, 'hs': [r.h]}) END
  FROM (SELECT *, bands[-1] AS last, list_sort(bands[-1].hs)[len(bands[-1].hs) // 2 + 1] AS med FROM b) b JOIN r ON r.page = b.page AND r.k = b.k + 1),
e AS (SELECT page, bands FROM b QUALIFY row_number() OVER (PARTITION BY page ORDER BY k DESC) = 1),
u AS (SELECT page, CAST(unnest(range(len(bands))) AS INTEGER) AS band, unnest(bands) AS v FROM e),
z AS (SELECT page, band, v.x AS x, v.y AS y, v.x1 - v.x AS w, v.y1 - v.y AS h, list_sort(v.hs)[len(v.hs) // 2 + 1] AS med_h, CAST(len(v.hs) AS INTEGER) AS lines FROM u)"""

_MARKS = ("\\n", "\\. ", "! ", "\\? ", "; ", ", ", " ")
#: Pieces of a text: after the best mark past two fifths of the limit, else at the limit.
_CUT = "CASE " + " ".join(f"WHEN length(regexp_extract(head, '(?s)^(.*){m}', 1)) > 192 THEN length(regexp_extract(head, '(?s)^(.*){m}', 1)) + {len(m.replace(chr(92), '')) if m != _MARKS[0] else 1}" for m in _MARKS) + " ELSE 480 END"
_PIECES = f"""p AS (SELECT doc_id, -1 AS part, CAST(NULL AS VARCHAR) AS piece, coalesce(text, '') AS rest FROM documents
  UNION ALL SELECT doc_id, part + 1, CASE WHEN length(rest) > 480 THEN substr(rest, 1, cut) ELSE rest END, CASE WHEN length(rest) > 480 THEN substr(rest, cut + 1) ELSE '' END
  FROM (SELECT *, {_CUT} AS cut FROM (SELECT *, substr(rest, 1, 480) AS head FROM p)) WHERE rest <> '')"""

#: Text layers: items along a baseline join a line, scanned again while it grows; a state looks at one item a step.
_FONT = "greatest(b.font_height, list_max(list_transform(line, lambda e: e.font_height)))"
_REACH = f"""(abs(b.base_y - line[1].base_y) <= greatest(3, 0.35 * {_FONT}) AND b.x - list_max(list_transform(line, lambda e: e.x + e.w)) <= greatest(12, 1.2 * {_FONT})
  AND list_min(list_transform(line, lambda e: e.x)) - (b.x + b.w) <= greatest(8, {_FONT}))"""
_LAYER = f"""t AS (SELECT page, no, x, y - 0.85 * h AS y, CASE WHEN no % 3 <> 0 THEN w ELSE greatest(h * 0.5, length(src) * h * 0.5) END AS w, 1.15 * h AS h, h AS font_height, y AS base_y, src AS raw FROM boxes),
s AS (SELECT page, list_sort(list({{'base_y': base_y, 'x': x, 'y': y, 'w': w, 'h': h, 'font_height': font_height, 'raw': raw}})) AS l FROM t GROUP BY page),
g AS (SELECT page, 0 AS k, l[1:1] AS line, l[2:] AS todo, l[1:0] AS rest, false AS grown, [l[1:0]] AS done, false AS ended FROM s
  UNION ALL SELECT page, k + 1,
    CASE WHEN len(todo) > 0 THEN CASE WHEN joins THEN list_append(line, b) ELSE line END WHEN again THEN line ELSE rest[1:1] END,
    CASE WHEN len(todo) > 0 THEN todo[2:] WHEN again THEN rest ELSE rest[2:] END,
    CASE WHEN len(todo) > 0 THEN CASE WHEN joins THEN rest ELSE list_append(rest, b) END ELSE rest[1:0] END,
    CASE WHEN len(todo) > 0 THEN grown OR joins ELSE false END,
    CASE WHEN len(todo) > 0 OR again THEN done ELSE list_append(done, line) END,
    len(todo) = 0 AND NOT again AND len(rest) = 0
  FROM (SELECT *, len(todo) = 0 AND grown AND len(rest) > 0 AS again, coalesce({_REACH}, false) AS joins FROM (SELECT *, todo[1] AS b FROM g WHERE NOT ended))),
d AS (SELECT page, unnest(range(1, len(done))) AS line_no, unnest(done[2:]) AS line FROM g WHERE ended),
i AS (SELECT page, line_no, unnest(range(len(line))) AS nth, unnest(line) AS e FROM d),
j AS (SELECT page, line_no, e, row_number() OVER w AS nth, lag(e.x + e.w) OVER w AS before, lag(e.font_height) OVER w AS font FROM i WINDOW w AS (PARTITION BY page, line_no ORDER BY e.x, nth))"""

#: Layout: every size, spacing and width that may be tried wraps the text, a character a step.
_TRY = """c AS (SELECT DISTINCT src AS text, w, h FROM boxes), z AS (SELECT text, w, h, 0 AS rung, greatest(floor(h * CAST(0.92 AS DOUBLE)), 6) AS fs FROM c
  UNION ALL SELECT text, w, h, rung + 1, floor(fs * CAST(0.92 AS DOUBLE)) FROM z WHERE fs > 6),
v AS (SELECT unnest(range(4)) AS nth, unnest([CAST(0 AS DOUBLE), -0.012, -0.025, -0.04]) AS sp),
q AS (SELECT z.*, nth, sp, false AS minor, w AS most FROM z, v UNION ALL SELECT z.*, nth, sp, true, greatest(w, least(w + 2 * fs, w * CAST(1.12 AS DOUBLE))) FROM z, v),
a AS (SELECT *, 0 AS i, 0 AS n, 0 AS lines, CAST(0 AS DOUBLE) AS widest FROM q
  UNION ALL SELECT text, w, h, rung, fs, nth, sp, minor, most, i + 1,
    CASE WHEN breaks THEN CASE WHEN ch = ' ' THEN 0 ELSE 1 END ELSE n + 1 END, lines + CASE WHEN breaks THEN 1 ELSE 0 END, CASE WHEN breaks THEN greatest(widest, own) ELSE widest END
  FROM (SELECT *, n > 0 AND fs * (CAST(0.55 AS DOUBLE) * (n + 1)) + sp * fs * n > most AS breaks, substr(text, i + 1, 1) AS ch,
    fs * (CAST(0.55 AS DOUBLE) * n) + sp * fs * greatest(0, n - 1) AS own FROM a WHERE i < length(text))),
y AS (SELECT *, lines + CASE WHEN n > 0 THEN 1 ELSE 0 END AS total, CASE WHEN n > 0 THEN greatest(widest, fs * (CAST(0.55 AS DOUBLE) * n) + sp * fs * greatest(0, n - 1)) ELSE widest END AS broad FROM a WHERE i = length(text)),
ok AS (SELECT *, total * fs * CAST(1.02 AS DOUBLE) <= greatest(h, h * CAST(1.35 AS DOUBLE)) AND broad <= most + 0.5 AS fits FROM y),
st AS (SELECT text, w, h, first(fs ORDER BY rung, nth) AS fs, first(total ORDER BY rung, nth) AS total FROM ok WHERE fits AND NOT minor GROUP BY ALL),
b0 AS (SELECT text, w, h, fs AS start FROM z WHERE rung = 0),
mi AS (SELECT o.text, o.w, o.h, first(o.fs ORDER BY o.rung, o.nth) AS fs, first(o.total ORDER BY o.rung, o.nth) AS total FROM ok o JOIN b0 USING (text, w, h) LEFT JOIN st USING (text, w, h)
  WHERE o.fits AND o.minor AND (st.fs IS NULL OR (st.fs < start * CAST(0.8 AS DOUBLE) AND o.fs > st.fs)) GROUP BY ALL),
la AS (SELECT text, w, h, fs, total FROM ok WHERE NOT minor AND fs <= 6 AND nth = 3),
ch AS (SELECT b0.text, b0.w, b0.h, start, coalesce(mi.fs, st.fs, la.fs) AS fs, coalesce(mi.total, st.total, la.total) AS total, mi.fs IS NULL AND st.fs IS NULL AS overflow
  FROM b0 LEFT JOIN mi USING (text, w, h) LEFT JOIN st USING (text, w, h) LEFT JOIN la USING (text, w, h))"""

MORE = {
    "items_dedupe_overlapping": f"{_BOXES}, {_dedupe('a', 'boxes')} SELECT * FROM a",
    "items_dedupe_same_text": f"{_BOXES}, {_fold('a', 'boxes', 'floor(y / 16), x, -(w * h), no', ITEM, _unless(_ratio('o', 'b') + ' > 0.5 AND ' + _SAME.format('src')))} SELECT * FROM a",
    "items_merge_adjacent": f"{_BOXES}, {_merge('a', 'boxes')} SELECT * FROM a",
    "items_prepare": f"{_BOXES}, {_dedupe('a', 'boxes')}, {_merge('m', 'a')}, {_dedupe('n', 'm')}, {_collapse('c', 'n')} SELECT page, no, x, y, w, h, src, dst FROM c",
    "tiles_drop_repeats": f"{_BOXES}, {_fold('a', 'boxes', 'no', ('no', 'x', 'y', 'w', 'h'), _unless(_ratio('o', 'b') + ' > 0.5'))} SELECT * FROM a",
    "ocr_drop_reread": f"""{_BOXES}, source AS (SELECT page, no, x, y, w, h, src AS text, CAST(no * 37 % 100 AS DOUBLE) AS conf FROM boxes),
{_fold('a', 'source', 'no', ('no', 'x', 'y', 'w', 'h', 'text', 'conf'), _replace(f"list_position(list_transform(f.kept, lambda b: {_ratio('o', 'b')} > 0.5 AND {_SAME.format('text')}), true)", 'o.conf > b.conf'))} SELECT * FROM a""",
    "boxes_group_blocks": f"{_BOXES}, source AS (SELECT *, 0.0 AS ink FROM boxes), {_BLOCKS} SELECT page, CAST(block AS INTEGER) AS block, e.x AS x, e.y AS y, e.w AS w, e.h AS h, e.n AS members FROM d",
    "regions_from_lines": f"""{_BOXES}, source AS (SELECT *, floor(w * h * CAST(0.3 AS DOUBLE)) AS ink FROM boxes), {_BLOCKS},
q AS (SELECT page, block, e.x AS x, e.y AS y, greatest(1.0, e.w) AS w, greatest(1.0, e.h) AS h, e.ink AS ink, e.n AS lines FROM d),
c AS (SELECT *, least(1.0, 0.5 * CASE WHEN ink / (w * h) BETWEEN 0.06 AND 0.62 THEN 1.0 ELSE 0.35 END + 0.12 * least(lines, 6)) AS score FROM q)
SELECT page, CAST(row_number() OVER (PARTITION BY page ORDER BY floor(y / 16), x, score DESC, ink DESC, block) - 1 AS INTEGER) AS region, x, y, w, h, CAST(ink AS BIGINT) AS ink, lines, CAST(score AS DOUBLE) AS score FROM c""",
    "ocr_plan_bands": f"{_BOXES}, {_BANDS} SELECT *, least(least(4.0, greatest(1.0, 32 / med_h)), greatest(1.0, 2600 / greatest(w, h))) AS zoom FROM z",
    "text_split_for_limit": f"WITH RECURSIVE {_PIECES} SELECT doc_id, part, length(piece) AS n, md5(piece) AS digest FROM p WHERE part >= 0",
    "pdf_group_items": f"""{_BOXES}, {_LAYER}, k AS (SELECT page, line_no, min(e.x) AS x, min(e.y) AS y, max(e.x + e.w) - min(e.x) AS w, max(e.y + e.h) - min(e.y) AS h, max(e.font_height) AS font_height,
  string_agg(CASE WHEN e.x - before > greatest(1.2, 0.18 * least(font, e.font_height)) THEN ' ' ELSE '' END || e.raw, '' ORDER BY nth) AS text, CAST(count(*) AS INTEGER) AS parts FROM j GROUP BY page, line_no)
SELECT page, x, y, w, h, font_height, text, parts FROM k""",
    "layout_fit": f"{_BOXES}, {_TRY} SELECT page, no, CAST(fs AS DOUBLE) AS font_size, total AS lines, overflow, fs < start AS shrunk FROM boxes JOIN ch ON ch.text = src AND ch.w = boxes.w AND ch.h = boxes.h",
}

#: A fake reader answers four bands in five, with one line each.
MORE["recognise_report"] = f"""{_BOXES}, {_BANDS} SELECT page, count(*) AS bands, count(*) FILTER ((page + band) % 5 <> 4) AS calls, count(*) FILTER ((page + band) % 5 <> 4) AS raw FROM z GROUP BY page"""
