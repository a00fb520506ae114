"""Known inputs with known results."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioflow.functions import geometry as G
from folioflow.functions import semijson as J
from folioflow.functions import text as T
from folioflow.operators import boxes as B
from folioflow.operators import glossary as L
from folioflow.operators import kernels as K
from folioflow.operators import layout as Y
from folioflow.operators import ocr as O
from folioflow.operators import pixels as P


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def box(*v):
    return G.Box(*(F.lit(float(x)) for x in v))


def items(spark, rows):
    return spark.createDataFrame([(1, i, *map(float, r[:4]), *r[4:]) for i, r in enumerate(rows)], "page long, no int, x double, y double, w double, h double, src string, dst string")


def test_overlap(spark):
    big, small = box(0, 0, 100, 20), box(10, 2, 20, 16)
    assert value(spark, G.overlap_ratio(big, small)) == 1 and value(spark, G.iou(big, small)) < 0.25
    assert not value(spark, G.intersects(box(0, 0, 10, 10), box(10, 0, 5, 5)))


@pytest.mark.parametrize("rows, left", [
    ([(10, 10, 100, 20, "Skirt", ""), (12, 11, 98, 19, "Skirf", "")], 1),
    ([(10, 10, 100, 20, "a", ""), (10, 32, 100, 20, "b", "")], 2),
    ([(10, 10, 100, 20, "a", ""), (300, 10, 100, 20, "b", "")], 2),
])
def test_dedupe(spark, rows, left):
    assert B.dedupe_overlapping(items(spark, rows)).count() == left


def test_dedupe_keeps_the_translated_one(spark):
    out = B.dedupe_overlapping(items(spark, [(10, 10, 100, 20, "Skirt", ""), (12, 11, 98, 19, "Skirt", "裙子")])).collect()
    assert [r.dst for r in out] == ["裙子"]


PAIR = [(20, 30, 40, 12, "MATERIAL", "材质"), (64, 30, 30, 12, "SPEC", "规格")]


def test_merge(spark):
    r, = B.merge_adjacent(items(spark, PAIR)).collect()
    assert (r.x, r.y, r.w, r.h, r.src, r.dst, r.merged) == (20, 30, 74, 12, "MATERIAL SPEC", "材质规格", 1)
    far = [PAIR[0], (200, 30, 40, 12, "SIZE", "尺寸")]
    assert B.prepare_items(items(spark, far)).count() == 2
    assert [(r.src, r.dst) for r in B.prepare_items(items(spark, far), "whole").collect()] == [("MATERIAL SIZE", "材质尺寸")]
    three = [(0, 0, 10, 12, "A", "甲"), (14, 0, 10, 12, "B", "乙"), (28, 0, 10, 12, "C", "丙")]
    assert [(r.src, r.dst, r.merged) for r in B.merge_adjacent(items(spark, three)).collect()] == [("A B C", "甲乙丙", 2)]


def test_same_text_keeps_different_ones(spark):
    rows = [(100, 100, 80, 24, "Front", ""), (106, 102, 78, 24, "Back", "")]
    assert B.dedupe_same_text(items(spark, rows)).count() == 2
    assert B.dedupe_same_text(items(spark, [rows[0], (106, 102, 78, 24, "front", "")])).count() == 1


def test_blocks(spark):
    rows = [(100, y, 200, 12, "", "") for y in (100, 120, 140)] + [(600, 400, 100, 12, "", "")]
    out = sorted(tuple(r)[2:] for r in B.group_blocks(items(spark, rows)).collect())
    assert out == [(100, 100, 200, 52, 3), (600, 400, 100, 12, 1)]


def test_neighbour_limits(spark):
    a, b = B.neighbour_limits(items(spark, [(0, 0, 100, 20, "", ""), (0, 24, 100, 20, "", "")]), 1000.0, 800.0).orderBy("no").collect()
    assert a.bottom <= 24 and a.allow_h < 27
    solo, = B.neighbour_limits(items(spark, [(50, 50, 100, 20, "", "")]), 1000.0, 800.0).collect()
    assert abs(solo.allow_h - 27) < 1e-9


@pytest.mark.parametrize("raw, want", [
    ([0, 0, 1000, 1000], (100, 50, 100, 60)), ([250, 250, 750, 750], (125, 65, 50, 30)), ([0, 0, 1, 1], (100, 50, 100, 60)), ([-500, -500, 2000, 2000], (150, 80, 58, 34.8)),
])
def test_crop_mapping(spark, raw, want):
    b = G.map_from_crop(G.normalise_1000([F.lit(float(v)) for v in raw]), 100.0, 50.0, 100.0, 60.0, 1000.0, 800.0)
    assert value(spark, F.array(*b)) == pytest.approx(list(want))


def test_missing_box_falls_back(spark):
    b = G.map_from_crop(F.lit(None).cast("array<double>"), 0.0, 0.0, 100.0, 60.0, 800.0, 600.0)
    _, _, w, h = value(spark, F.array(*b))
    assert w >= 24 and h >= 12


def test_crop_plan(spark):
    c = G.crop_for_region(box(100, 100, 500, 200), 2000.0, 3000.0)
    assert value(spark, F.array(c["w"], c["h"], c["pad"], c["scale"])) == pytest.approx([620, 320, 60, 640 / 620])


@pytest.mark.parametrize("a, b, same", [("SEPARATE PIECE", "SEPARRTE PIECE", True), ("Front", "Back", False)])
def test_same_text(spark, a, b, same):
    assert value(spark, T.same_text(F.lit(a), F.lit(b))) is same


@pytest.mark.parametrize("raw, clean", [('"Front"', "Front"), ("- Front:", "Front"), ('3.5"', '3.5"'), ('12" x 8"', '12" x 8"')])
def test_clean(spark, raw, clean):
    assert value(spark, T.clean_text(F.lit(raw))) == clean


@pytest.mark.parametrize("text, conf, noise", [("", 90, True), ("A", 90, True), ("|||||", 90, True), ("###", 90, True), ("Material", 20, True), ("xzqwrt", 90, True), ("Material", 90, False), ("PMS", 90, False), ("SKU-11227J", 90, False), ("材质规格", 90, False)])
def test_noise(spark, text, conf, noise):
    assert value(spark, T.looks_like_noise(F.lit(text), F.lit(conf))) is noise


@pytest.mark.parametrize("text, kind", [("PMS 1234 C", "code"), ("45 in", "code"), ("100%", "code"), ("SEPARATE PIECE", "label"), ("材质规格", "label"), ("this one is a rather long remark about cloth", "note")])
def test_field(spark, text, kind):
    assert value(spark, T.classify_field(F.lit(text))) == kind


def test_json():
    assert J.extract('```json\n{"a": 1}\n```') == {"a": 1} and J.extract('so [1, 2] it is') == [1, 2] and J.extract('{"a": 1,}') == {"a": 1} and J.extract("nothing") is None
    item, = J.parse_reply('{items:[{text:"Front",translation:"正面",box:[0,0,10,10],},],}')
    assert item == {"src": "Front", "dst": "正面", "box": [0, 0, 10, 10]}
    assert [J.pick_box(x) for x in ({"bbox_2d": [100, 200, 400, 260]}, {"box": {"x": 5, "y": 6, "w": 100, "h": 40}}, {"box": {"left": 200, "top": 30, "right": 350, "bottom": 70}}, {"x0": 0, "y0": 0, "x1": 500, "y1": 100})] == [[100, 200, 400, 260], [5, 6, 105, 46], [200, 30, 350, 70], [0, 0, 500, 100]]


def test_tsv(spark):
    lines = ["4\t1\t1\t1\t1\t0\t10\t20\t120\t16\t-1\t", "5\t1\t1\t1\t1\t1\t10\t20\t70\t16\t95.0\tMATERIAL", "5\t1\t1\t1\t1\t2\t90\t20\t40\t16\t90.0\tSPEC", "5\t1\t1\t1\t2\t1\t10\t50\t90\t16\t88.0\tPolyester"]
    out = O.tsv_lines(O.parse_tsv(spark.createDataFrame([(x,) for x in lines], "line string"))).orderBy("line_num").collect()
    assert [(r.text, r.conf, r.x, r.y, r.w, r.h) for r in out] == [("MATERIAL SPEC", 92.5, 10, 20, 120, 16), ("Polyester", 88.0, 10, 50, 90, 16)]


@pytest.mark.parametrize("entries, text, want", [
    ([("Shoes", "鞋子", False), ("Shoes Laces", "鞋带", False)], "shoes LACES", "鞋带"), ([("DEV. STAGE", "x", False)], "DEVXSTAGE", "DEVXSTAGE"), ([("Price$", "价格", False)], "Price$ 100", "价格 100"),
    ([("Back", "背面", False)], "Backpack, back, Back panel, (Back), Back_pack", "Backpack, 背面, 背面 panel, (背面), Back_pack"), ([("Back", "背面", False), ("x", "y", True)], "Back x", "背面 x"),
])
def test_glossary(spark, entries, text, want):
    assert value(spark, L.apply_glossary(F.lit(text), entries)) == want
    assert value(spark, L.apply_glossary(F.lit(text), [*entries, ("unseen term", "z", False)])) == want


def test_codes(spark):
    text = F.lit("PMS 1234 C, 4'5\", 160cm, 65%")
    masked = T.mask_codes(text)
    assert value(spark, F.size(T.codes(text))) >= 3 and not value(spark, masked.rlike("[A-Za-z]"))
    assert value(spark, T.restore_codes(masked, T.codes(text))) == "PMS 1234 C, 4'5\", 160cm, 65%"
    known = F.array(F.lit("AB-12"))
    assert value(spark, T.restore_codes(F.lit(f"{T.OPEN} ０ {T.CLOSE}"), known)) == "AB-12"
    assert value(spark, T.restore_codes(F.lit(f"{T.OPEN}9{T.CLOSE}"), known)) == f"{T.OPEN}9{T.CLOSE}"


def test_translation_sends_distinct_texts_once(spark):
    calls = spark.sparkContext.accumulator(0)

    def engine(texts):
        calls.add(len(texts))
        return [f"<{t}>" for t in texts]

    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["Hello", "Hello", " Hello", "", "中文已存在"])], "no int, src string")
    out = L.translate(rows, [], engine).orderBy("no").collect()
    assert calls.value == 1 and [r.engine for r in out] == ["engine"] * 3 + ["skip"] * 2 and out[0].dst == "<Hello>"


def test_failed_texts_do_not_lose_the_others(spark):
    rows = spark.createDataFrame([(0, "Hello"), (1, "World")], "no int, src string")
    done = L.translate(rows, [], lambda texts: [None if t == "World" else "你好" for t in texts])
    with pytest.raises(L.Incomplete) as e:
        L.complete(done)
    assert e.value.failed == 1 and {(r.src, r.engine) for r in e.value.partial.collect()} == {("Hello", "engine"), ("World", "failed")}
    assert L.complete(done.where("no = 0")).count() == 1


@given(st.text(alphabet="ab ,.;\n" + T.OPEN + "0" + T.CLOSE, max_size=400), st.integers(5, 60))
@settings(max_examples=80, deadline=None)
def test_pieces_add_up(text, limit):
    out = L.split_for_limit(text, limit)
    assert "".join(out) == text and all(len(p) <= limit for p in out)


def em(text):
    """What a layout test measures with: every character one em wide."""
    return "中" * len(text)


def test_layout():
    """Known sizes of the ladder: spacing before size, a small overflow before shrinking, the smallest size last."""
    a = Y.fit("中" * 7, 0, 0, 150, 24, Y.Limits(allow_h=40))
    assert (a["font_size"], a["spacing"], a["tightened"], a["overflow"], a["overflow_x"]) == (22, -0.04, True, False, False) and a["widest"] <= 150.5
    b = Y.fit("中" * 9, 0, 0, 130, 20, Y.Limits(allow_h=32))
    assert b["font_size"] == 16 and b["overflow_x"] and not b["overflow"] and b["widest"] <= 130 * 1.12 + 0.5
    c = Y.fit("中" * 9, 0, 0, 130, 20, Y.Limits(allow_h=32, allow_w=118))
    assert not c["overflow_x"] and c["font_size"] < 16
    d = Y.fit(em("eight of"), 0, 0, 100, 20, Y.Limits(allow_h=27))
    assert d["font_size"] < 18 and d["block_h"] <= 27 and d["shrunk"]
    e = Y.fit("long text that cannot fit at all", 0, 0, 30, 8, Y.Limits(allow_h=10))
    assert e["overflow"] and (e["font_size"], e["spacing"]) == (6, -0.04) and all(map(math.isfinite, (e["block_h"], e["widest"], e["y"])))


def test_layout_ladder_and_place():
    assert Y.sizes(24, Y.Limits()) == [22, 20, 18, 16, 14, 12, 11, 10, 9, 8, 7, 6]
    assert Y.sizes(24, Y.Limits(largest=15.5)) == [15.5, 14, 12, 11, 10, 9, 8, 7, 6] and Y.sizes(24, Y.Limits(largest=30.7, from_largest=True))[0] == 30
    assert Y.sizes(3, Y.Limits()) == [6]
    one = Y.fit("中", 0, 100, 50, 20)
    assert (one["font_size"], one["line_height"], one["y"]) == (18, 18 * 1.02, 100 + (20 - 18 * 1.02) / 2)
    low = Y.fit("中" * 12, 0, 100, 60, 20, Y.Limits(allow_h=60, top=95, bottom=160))
    assert 95 <= low["y"] and low["y"] + low["block_h"] <= 160
    assert Y.wrap("中文（中文", 45, 15) == ["中文", "（中文"] and Y.wrap("中文。中", 30, 15) == ["中文。", "中"] and Y.wrap("ab cd", 17, 10) == ["ab ", "cd"]
    assert Y.wrap("", 10, 10) == [] and Y.wrap("ab", 0, 10) == ["ab"]


@given(st.text(alphabet="ab 中文，（。", max_size=60), st.integers(10, 80), st.sampled_from([0.0, -0.04]))
@settings(max_examples=60, deadline=None)
def test_wrapping_loses_only_blanks(text, width, spacing):
    lines = Y.wrap(text, width, 12, spacing)
    assert "".join(lines).replace(" ", "") == text.replace(" ", "")


def test_bands():
    rows = [{"x": 10, "y": 10 + 12 * i, "w": 200, "h": 8} for i in range(4)] + [{"x": 10, "y": 300 + 60 * i, "w": 400, "h": 40} for i in range(2)]
    small, large = O.bands_of(rows)
    assert small["zoom"] > large["zoom"] and small["zoom"] <= 4


GLYPHS = {"H": (1, 1, 1), "E": (1, 0, 1), "L": (1, 0, 0), "O": (1, 1, 0)}


def draw(plane, text, x, y, w=7, h=10, gap=2):
    for c in text:
        plane[y : y + h, x] = 0
        left, right, mid = c in "HELO", c in "HO", c in "HE"
        if right:
            plane[y : y + h, x + w - 1] = 0
        if mid:
            plane[y + h // 2, x : x + w] = 0
        if c in "ELO":
            plane[y + h - 1, x : x + w] = 0
        if c in "EO":
            plane[y, x : x + w] = 0
        x += w + gap


def test_detects_lines_and_not_rules():
    plane = np.full((600, 800), 255, dtype=np.uint8)
    for y in (50, 80, 110, 140, 170, 200):
        draw(plane, "HELLO", 80, y)
    plane[400:408] = 0
    plane[460:540, 100:300] = 0
    found = sorted(line["y"] for line in K.detect(plane))
    assert len(found) == 6 and all(abs(a - b) <= 4 for a, b in zip(found, (50, 80, 110, 140, 170, 200)))
    blank = np.full((600, 800), 255, dtype=np.uint8)
    blank[100:400, 100:700] = 0
    assert K.detect(blank) == []


def test_components_and_dilation():
    m = np.zeros((20, 60), dtype=bool)
    m[5:8, 10:13] = m[5:8, 16:19] = True
    assert len(K.components(m)) == 2
    one, = K.components(K.spread(m, 3, 0), m)
    assert (one["x"], one["w"], one["h"], one["ink"]) == (7, 15, 3, 18) and one["density"] == 18 / 45


def test_long_lines_go_and_input_stays():
    m = np.zeros((120, 400), dtype=bool)
    m[20:22, 20:320] = m[40:80, 100:160] = m[100:102, 50:62] = True
    before = m.copy()
    out = K.without_long_lines(m, 80, 3)
    assert (m == before).all() and m.sum() - out.sum() == 600 and out[50, 120] and out[100, 55]


def test_erase_leaves_no_ink():
    image = np.full((60, 200, 3), 230, dtype=np.uint8)
    plane = np.full((60, 200), 230, dtype=np.uint8)
    draw(plane, "HELLO", 40, 20)
    image[plane == 0] = 10
    out = K.erase_text(image)
    assert out.min() > 200 and (image.min() == 10)


def test_relation_and_kernel_agree(spark):

    rng = np.random.default_rng(2)
    planes = rng.integers(0, 256, (5, 8, 8)).astype(np.uint8)
    px = spark.createDataFrame([(p, y, x, int(planes[p, y, x])) for p in range(5) for y in range(8) for x in range(8)], "page long, y int, x int, lum int")
    ink = {(r.page, r.y, r.x): r.ink for r in P.adaptive_ink(px).collect()}
    for p in range(5):
        want = K.adaptive(planes[p], 5, 8.0)
        assert all(bool(ink[p, y, x]) == want[y, x] for y in range(8) for x in range(8))
    assert {r.page: r.threshold for r in P.otsu(px).collect()} == {p: K.otsu(planes[p]) for p in range(5)}
    found = sorted((r.page, r.x, r.y, r.w, r.h, r.ink) for r in P.components(P.adaptive_ink(px)).collect())
    assert found == sorted((p, c["x"], c["y"], c["w"], c["h"], c["ink"]) for p in range(5) for c in K.components(K.adaptive(planes[p], 5, 8.0)))


def page_with_text(base=(240, 240, 240)):
    image = np.full((60, 120, 3), base, dtype=np.uint8)
    image[20:28, 20:24] = image[20:28, 30:34] = image[20:28, 40:44] = 10
    return image


def test_cover_fills_plain_ground_and_spares_a_rule():
    image = page_with_text()
    image[32:34] = 0
    filled, done = K.cover(image, 10, 15, 50, 15, "fill")
    assert done["mode"] == "fill" and (filled[15:30, 10:60] == 240).all() and (filled[32:34] == 0).all()
    inked, done = K.cover(image, 10, 15, 50, 25, "ink")
    assert done["mode"] == "ink" and done["residual"] == 0 and (inked[20:28, 20:44] == 240).all() and (inked[32:34] == 0).all()


def test_cover_falls_back_and_reports():
    image = page_with_text()
    image[:, ::2] //= 2
    assert K.cover(image, 10, 15, 50, 15, "fill")[1]["mode"] == "ink"
    same, done = K.cover(page_with_text(), 10, 15, 2, 15)
    assert done["mode"] is None and (same == page_with_text()).all()
    blank = np.full((60, 120, 3), 200, dtype=np.uint8)
    assert K.cover(blank, 10, 10, 40, 40, "repair")[1]["mode"] is None


@pytest.mark.parametrize("reply, want", [
    ('[{"id":1,"translation":"b"},{"id":0,"translation":"a"}]', ["a", "b"]), ('["a","b"]', ["a", "b"]), ('[{"translation":"a"},{"id":0,"translation":"z"}]', ["z", "a"]),
    ('{"translations":[{"id":"1","zh":"b"}]}', [None, "b"]), ("sorry", [None, None]), ('[{"id":7,"dst":"x"},{"text":"echo"}]', ["x", None]),
])
def test_batch_answers(reply, want):
    assert J.answers_of(reply, 2) == want


def test_single_answer():
    assert J.single_answer('"Hi"') == "Hi" and J.single_answer('{"translation":" x "}') == "x" and J.single_answer(None) == ""


def test_tiles_cover_a_page(spark):
    assert len(value(spark, G.tiles(F.lit(1000.0), F.lit(900.0)))) == 1
    found = value(spark, G.tiles(F.lit(4000.0), F.lit(1500.0)))
    seen = np.zeros((1500, 4000), dtype=int)
    for t in found:
        seen[int(t["y"]) : int(t["y"] + t["h"]), int(t["x"]) : int(t["x"] + t["w"])] += 1
    assert len(found) == 6 and seen.min() == 1 and seen.max() > 1


def test_measured_lines_and_alignment(spark):
    ink = {(y, x) for y in (4, 5, 6, 14, 15, 16) for x in (range(10, 50) if y < 10 else range(20, 40))}
    px = spark.createDataFrame([(1, y, x, *[0 if (y, x) in ink else 255] * 3) for y in range(24) for x in range(60)], "page long, y int, x int, r int, g int, b int")
    r = P.measure_ink(px).first()
    assert (r.x, r.y, r.w, r.h, r.line_count, r.line_height, r.alignment, r.dark) == (10, 4, 40, 13, 2, 3.0, "center", False)
