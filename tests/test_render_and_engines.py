"""The render chain, engines, service rules, resampling and recognition from end to end, on small known cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.functions import service as S
from folioflow.operators import boxes as B
from folioflow.operators import engines as E
from folioflow.operators import kernels as K
from folioflow.operators import recognition as N
from folioflow.operators import render as R

ITEM = "page long, no int, x double, y double, w double, h double, src string, dst string, engine string, font_height double, free double, " + f"ink {R.INK}"
CAP = {"engine": "llm", "free": 0.0, "median_h": 0.0, "size_cap": 20.0, "top": 0.0, "bottom": 400.0, "left": 0.0, "right": 400.0, "allow_h": 30.0, "ink": None}


def ink(x, y, w, h, line_height, lines=1, alignment="left"):
    return {"x": x, "y": y, "w": w, "h": h, "line_height": line_height, "line_count": lines, "alignment": alignment}


def test_place_starts_at_the_cap_and_covers_both():
    p = R.place(CAP | {"x": 100.0, "y": 100.0, "w": 100.0, "h": 20.0, "dst": "中文"})
    assert p["layout"]["font_size"] == 20 and p["draw_x"] == 100 and p["relayout"] == 0
    assert p["cover"] == {"x": 95, "y": 100 - 0.2 - 6 if p["layout"]["y"] < 100 else 94, "w": 110, "h": pytest.approx(p["cover"]["h"])}
    assert p["cover"]["y"] <= p["layout"]["y"] and p["cover"]["y"] + p["cover"]["h"] >= p["layout"]["y"] + p["layout"]["block_h"]


def test_place_follows_alignment_and_ink():
    wide = CAP | {"x": 100.0, "y": 100.0, "w": 200.0, "h": 20.0, "dst": "中文", "ink": ink(150.0, 102.0, 100.0, 14.0, 14.0, 1, "center")}
    p = R.place(wide)
    assert p["draw_x"] == pytest.approx(150 + (100 - p["layout"]["widest"]) / 2)
    right = R.place(wide | {"ink": ink(150.0, 102.0, 100.0, 14.0, 14.0, 1, "right")})
    assert right["draw_x"] == pytest.approx(250 - right["layout"]["widest"])
    guessed = R.place(wide | {"engine": "vision-x"})
    assert guessed["cover"]["x"] > 140 and R.place(wide | {"ink": ink(102.0, 101.0, 190.0, 18.0, 14.0)})["cover"]["x"] < 100


def test_a_cover_that_neighbours_narrow_is_laid_again():
    tight = CAP | {"x": 100.0, "y": 100.0, "w": 60.0, "h": 20.0, "dst": "中文中文中文", "right": 165.0, "allow_h": 44.0, "top": 90.0, "bottom": 140.0}
    p = R.place(tight)
    assert p["layout"]["widest"] <= p["cover"]["w"] + 0.5 and p["cover"]["x"] + p["cover"]["w"] <= 165
    assert p["draw_x"] + p["layout"]["widest"] <= p["cover"]["x"] + p["cover"]["w"] + 0.5


def test_lines_near_those_of_the_original():
    two = CAP | {"x": 100.0, "y": 100.0, "w": 80.0, "h": 40.0, "dst": "中文中文中文中", "size_cap": 16.0, "allow_h": 60.0, "ink": ink(100.0, 100.0, 80.0, 40.0, 18.0, 2)}
    assert len(R.place(two)["layout"]["lines"]) == 2


def test_render_plan_and_statistics(spark):
    rows = [
        (1, 1, 10.0, 10.0, 80.0, 14.0, "Front", "正面", "llm", None, 10.0, ink(12.0, 11.0, 70.0, 10.0, 10.0)), (1, 2, 10.0, 60.0, 80.0, 14.0, "Back", "", "llm", None, 0.0, None),
        (1, 3, 10.0, 90.0, 80.0, 14.0, "PMS", "PMS", "llm", None, 0.0, None), (1, 4, 10.0, 120.0, 0.0, 14.0, "Side", "侧面", "llm", None, 0.0, None),
        (1, 5, 10.0, 150.0, 20.0, 8.0, "A very long note", "很长很长很长很长很长很长的说明", "vision", 9.0, 0.0, None), (2, 1, 5.0, 5.0, 50.0, 12.0, "Zip", None, "llm", None, 0.0, None),
    ]
    items = spark.createDataFrame(rows, ITEM)
    drawn = items.where("no IN (1, 5) AND page = 1")
    plan = R.render_plan(items, B.neighbour_limits(drawn.select("page", "no", "x", "y", "w", "h"), 200.0, 200.0))
    stats = {r.page: r for r in R.render_statistics(plan).collect()}
    assert tuple(stats[1])[:6] == (1, 5, 2, 1, 1, 1) and tuple(stats[2])[:4] == (2, 1, 0, 1)
    placed = {r.no: r for r in plan.where("fate IS NULL").collect()}
    assert placed[1].place.layout.lines == ["正面"] and placed[1].size_cap >= 11 and placed[5].place.layout.font_size >= 6


def test_ink_heights_are_evened(spark):
    rows = [(1, n, ink(0.0, 0.0, 50.0, h, lh, c)) for n, (h, lh, c) in enumerate([(12.0, 12.0, 1), (12.0, 11.0, 1), (48.0, 48.0, 4), (36.0, 36.0, 1), (10.0, 3.0, 1)])]
    got = {r.no: (r.ink.line_height, r.ink.line_count, r.median_h) for r in R.even_ink(spark.createDataFrame(rows, f"page long, no int, ink {R.INK}")).collect()}
    assert got == {0: (12, 1, 12), 1: (11, 1, 12), 2: (12, 4, 12), 3: (12, 3, 12), 4: (10, 1, 12)}


def test_field_colours(spark):
    rows = spark.createDataFrame([("PMS 1234 C", False), ("SEPARATE PIECE", False), ("This is a long sentence about many parts", False), ("SEPARATE PIECE", True)], "t string, dark boolean")
    got = [list(r[0]) for r in rows.select(R.field_colour(F.col("t"), F.array(F.lit(9), F.lit(9), F.lit(9)), F.col("dark"))).collect()]
    assert got == [[138, 26, 92], [26, 79, 138], [31, 111, 58], [9, 9, 9]]


def page(high=60, wide=80, ground=(240, 240, 240)):
    return np.full((high, wide, 3), ground, dtype=np.uint8)


def test_ground_is_sampled_outside_the_box():
    rgb = page()
    rgb[24:34, 25:50:3] = (10, 20, 30)
    g = R.sample_ground(rgb, 20, 20, 40, 18)
    assert g["uniform"] and not g["dark"] and g["colour"].tolist() == [240] * 3 and g["text"].tolist() == [9, 18, 28]
    red = page()
    red[24:34, 25:50:3] = (200, 20, 20)
    assert R.sample_ground(red, 20, 20, 40, 18)["text"].tolist() == [190, 19, 19]
    night = page(ground=(20, 20, 20))
    assert R.sample_ground(night, 20, 20, 40, 18)["dark"] and R.sample_ground(night, 20, 20, 40, 18)["text"].tolist() == [245] * 3


def test_ground_is_painted_plain_or_blended():
    rgb = page()
    rgb[24:34, 25:50:3] = 0
    assert (R.paint_ground(rgb, 20, 20, 40, 18, R.sample_ground(rgb, 20, 20, 40, 18)) == 240).all()
    shaded = np.repeat(np.linspace(100, 220, 60)[:, None, None], 80, axis=1).repeat(3, axis=2).astype(np.uint8)
    out = R.paint_ground(shaded, 10, 10, 60, 40, R.sample_ground(shaded, 10, 10, 60, 40))
    inside = out[10:50, 30, 0].astype(int)  # three rows of ground: level for a sixth of the box at either end
    assert (np.diff(inside) >= 0).all() and abs(inside - shaded[10:50, 30, 0]).max() <= 21 and (out[:10] == shaded[:10]).all()


def test_resize_keeps_means_and_ends():
    a = np.arange(64, dtype=np.uint8).reshape(8, 8) * 3
    assert K.resize(a, 4, 4).tolist() == np.rint(a.reshape(4, 2, 4, 2).mean(axis=(1, 3))).astype(int).tolist()
    up = K.resize(a, 16, 16)
    assert up.shape == (16, 16) and (up[0, 0], up[-1, -1]) == (a[0, 0], a[-1, -1]) and (np.diff(up[:, 0].astype(int)) >= 0).all()
    assert K.resize(np.stack([a] * 3, axis=2), 5, 3).shape == (3, 5, 3) and K.resize(a[:1, :1], 3, 3).tolist() == [[0] * 3] * 3


def test_prepared_for_reading():
    a = page()[..., 0].copy()
    a[20:30, 20:22] = 30
    assert K.prepare_for_reading(a, 99).shape == (240, 320) and K.prepare_for_reading(a, 0.01).shape == (15, 20)
    ink = K.prepare_for_reading(a, 2, binarise=True)
    assert set(np.unique(ink)) == {0, 255} and ink[50, 42] == 0
    assert (K.prepare_for_reading(a, 1, amount=0) == a).all()


def test_engine_retries_what_may_pass():
    waits, calls = [], []

    def flaky(text):
        calls.append(text)
        if len(calls) < 3:
            raise E.Unavailable("busy", 4.0 if len(calls) == 1 else None)
        return text.upper()

    assert E.retried(flaky, 3, waits.append, lambda: 0.0)("a") == "A" and waits == [4.0, 1.0]
    with pytest.raises(E.Unavailable):
        E.retried(lambda t: (_ for _ in ()).throw(E.Unavailable("down")), 2, waits.append)("a")
    with pytest.raises(ValueError):
        E.retried(lambda t: (_ for _ in ()).throw(ValueError("wrong key")), 3, waits.append)("a")
    assert len(waits) == 3


def test_engine_chain_and_pieces():
    def down(text):
        raise OSError("no route")

    long = "word " * 180
    ask = E.chain([("first", down), ("empty", lambda t: " "), ("second", E.in_pieces(lambda t: t.upper(), 480))])
    got = ask(long)
    assert got.text == long.upper().strip() and got.engine == "second" and "480" in got.warn
    assert ask("hi") == E.Answer("HI", "second", "")
    assert E.chain([("first", down), ("empty", lambda t: "")])("hi") == E.Answer(None, "failed", "first: no route; empty: empty answer")


def test_engine_batches_by_number():
    asked = []

    def ask(prompt):
        asked.append(json.loads(prompt.split("\n\n", 1)[1]))
        return json.dumps([{"id": 2, "translation": "C"}, {"id": 0, "translation": "A"}])

    run = E.batched(ask, lambda t: t.upper() if t != "x" else (_ for _ in ()).throw(E.Unavailable("down")))
    assert run(["a", "b", "c"]) == ["A", "B", "C"] and [len(a) for a in asked] == [3]
    assert run(["a", "x", "c"]) == ["A", None, "C"]
    assert E.batched(lambda p: (_ for _ in ()).throw(E.Unavailable("down")), str.upper)(["a", "b"]) == ["A", "B"]


def test_prompts_say_what_is_asked():
    entries = [("Shoes", "鞋子", False), ("PMS", "", True)]
    both = S.reading_prompt("zh-TW", True, True, "3/7", "shoe sheets", entries)
    assert all(s in both for s in ("Traditional Chinese", "3/7", "shoe sheets", "Shoes => 鞋子", "PMS", '"translation"'))
    only = S.reading_prompt("zh-CN", False, False, entries=entries)
    assert "ranslat" not in only and "Shoes" not in only and '{"items":[]}' in only
    assert "Shoes => 鞋子" in S.translation_prompt("zh-CN", "", entries)
    assert json.loads(S.batch_prompt(["a", "b"]).split("\n\n", 1)[1]) == [{"id": 0, "text": "a"}, {"id": 1, "text": "b"}]


def drawn_page(high, wide, at):
    """A white page with rows of strokes as text at the given places."""
    plane = np.full((high, wide), 255, dtype=np.uint8)
    for y, x in at:
        for k in range(6):
            plane[y : y + 10, x + 9 * k] = 0
            plane[y, x + 9 * k : x + 9 * k + 6] = 0
            plane[y + 5, x + 9 * k : x + 9 * k + 6] = 0
    return plane


def test_tiles_find_what_one_piece_finds(spark):
    at = [(40, 50), (120, 60), (200, 300), (300, 150), (150, 260)]
    plane = drawn_page(360, 420, at)
    pages = spark.createDataFrame([(1, 420, 360, plane.tobytes())], "page long, width int, height int, lum binary")
    assert N.cut_tiles(pages, 250.0).count() == 4 and N.cut_tiles(pages, 1600.0).count() == 1
    whole = [r for r in N.detect_tiled(pages, 1600.0).collect() if r.kind == "line"]
    tiled = [r for r in N.detect_tiled(pages, 250.0).collect() if r.kind == "line"]
    for found in (whole, tiled):
        for y, x in at:
            assert any(abs(r.y - y) <= 4 and r.x <= x + 6 and r.x + r.w >= x + 45 for r in found), (y, x)
        assert sorted(r.no for r in found) == list(range(1, len(found) + 1))


def test_recognition_from_bands_to_lines(spark):
    """TSV words, a tree where no word is usable, a failing band, and a page without lines."""
    pages = spark.createDataFrame([(1, 400, 300), (2, 400, 300)], "page long, width int, height int")
    lines = spark.createDataFrame([(1, i, 20.0, y, 100.0, 10.0) for i, y in enumerate((10.0, 120.0, 230.0))], "page long, no int, x double, y double, w double, h double")

    def reader(bands):
        out = []
        for b in bands:
            box = (4, 2, 40, 12)
            row = "\t".join(map(str, (5, 1, 1, 1, 1, 1, *box, 91, "Material")))
            tree = json.dumps({"lines": [{"text": "Polyester", "confidence": 88, "bbox": {"x0": 0, "y0": 0, "x1": 32, "y1": 16}}]})
            unsure = "\t".join(map(str, (5, 1, 1, 1, 1, 1, *box, 3, "xzqwrt")))
            out.append(None if b["y"] > 200 else {"tsv": unsure, "tree": tree} if b["y"] > 100 else {"tsv": row, "tree": None})
        return out

    got, report = N.recognise(pages, lines, reader)
    rows = sorted((r.page, r.text, r.x, r.y, r.w, r.h, r.conf) for r in got.collect())
    zoom = 3.2
    assert rows[0] == (1, "Material", pytest.approx(20 + 4 / zoom), pytest.approx(10 + 2 / zoom), pytest.approx(40 / zoom), pytest.approx(12 / zoom), 91.0)
    assert rows[1][:2] == (1, "Polyester") and rows[1][3] == pytest.approx(120) and rows[2][:2] == (2, "Material") and len(rows) == 3
    assert sorted(map(tuple, report.collect())) == [(1, 3, 2, 2, 2), (2, 1, 1, 1, 1)]


def test_image_pages_of_all_kinds(spark, tmp_path):
    from folioflow.sources import files as S

    one = S._rgb(bytes([7, 9]), 2, 1, 1)
    assert one.tolist() == [[[7, 7, 7], [9, 9, 9]]]
    assert S._rgb(bytes([1, 2, 3]), 1, 1, 3).tolist() == [[[3, 2, 1]]]
    assert S._rgb(bytes([0, 0, 0, 0, 10, 20, 30, 255]), 2, 1, 4).tolist() == [[[255, 255, 255], [30, 20, 10]]]
