"""Sweeps against a literal loop, JPEG against another decoder, calls of services side by side."""

import base64
import json
import threading
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import calls as C
from folioflow.operators import jpeg as J
from folioflow.operators import kernels as K


def swept(rgb, mask, least=16, most=600, stop=1.2, omega=1.85):
    """One pixel after the other, forward and back."""
    h, w = mask.shape
    d = rgb.astype(np.float64)
    if mask.any() and not mask.all():
        d[mask] = np.sort(rgb[~mask], axis=0)[(~mask).sum() // 2]
    todo = [(y, x) for y in range(h) for x in range(w) if mask[y, x]]
    for k in range(most if todo else 0):
        far = 0.0
        for y, x in todo if k % 2 == 0 else todo[::-1]:
            near = [d[v, u] for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= v < h and 0 <= u < w]
            if near:
                new = d[y, x] + omega * (sum(near) / len(near) - d[y, x])
                far = max(far, np.abs(new - d[y, x]).sum())
                d[y, x] = np.clip(np.rint(new), 0, 255)
        if k + 1 >= least and far < stop:
            break
    return d.astype(np.uint8)


def test_sweep_equals_the_loop():
    rng = np.random.default_rng(4)
    cases = []
    for h, w, share in ((1, 1, 1), (1, 9, 0.5), (7, 1, 0.9), (12, 17, 0.3), (9, 9, 1), (20, 11, 0.7), (5, 30, 0)):
        cases.append((rng.integers(0, 256, (h, w, 3)).astype(np.uint8), rng.random((h, w)) < share))
    smooth = np.repeat(np.linspace(0, 255, 40)[None, :, None], 25, axis=0).repeat(3, axis=2).astype(np.uint8)
    block = np.zeros((25, 40), dtype=bool)
    block[5:20, 0:18] = block[3, 30] = True
    cases.append((smooth, block))
    together = K.inpaint_all([c[0] for c in cases], [c[1] for c in cases], most=60)
    for (rgb, mask), got in zip(cases, together):
        assert (got == swept(rgb, mask, most=60)).all() and (got == K.inpaint(rgb, mask, most=60)).all()
    assert (K.inpaint(smooth, block) == swept(smooth, block)).all()
    rgb, mask = cases[3]
    for most in (17, 18, 19, 120, 121):
        assert (K.inpaint(rgb, mask, most=most) == swept(rgb, mask, most=most)).all()
    assert K.inpaint_all([], []) == []


def test_gray_images_are_swept_on_one_channel(monkeypatch):
    rng = np.random.default_rng(9)
    cases = []
    for h, w, share in ((1, 1, 1), (1, 9, 0.5), (7, 1, 0.9), (2, 2, 1), (12, 17, 0.3), (9, 9, 1), (14, 11, 0.7), (5, 30, 0), (16, 16, 0.95)):
        cases.append((np.repeat(rng.integers(0, 256, (h, w, 1)).astype(np.uint8), 3, axis=2), rng.random((h, w)) < share))
    cases.append((np.repeat(np.where(np.arange(16) < 8, 0, 250)[None, :, None], 14, axis=0).repeat(3, axis=2).astype(np.uint8), np.pad(np.ones((10, 12), dtype=bool), 2)))
    with monkeypatch.context() as only:
        only.setattr(K, "_swept", lambda images, *rest: [] if not images else pytest.fail("gray images in colours"))
        for most in (0, 5, 15, 16, 17, 60, 61, 600):
            for (rgb, mask), got in zip(cases, K.inpaint_all([c[0] for c in cases], [c[1] for c in cases], most=most), strict=True):
                assert (got == swept(rgb, mask, most=most)).all()
    colour = (rng.integers(0, 256, (8, 9, 3)).astype(np.uint8), rng.random((8, 9)) < 0.6)
    mixed = [cases[4], colour, cases[6]]
    for (rgb, mask), got in zip(mixed, K.inpaint_all([c[0] for c in mixed], [c[1] for c in mixed]), strict=True):
        assert (got == swept(rgb, mask)).all()


def test_holes_are_what_no_way_leads_into():
    rng = np.random.default_rng(2)
    for h, w, share in ((1, 5, 0.5), (9, 1, 0.5), (30, 40, 0.5), (25, 25, 0.7), (6, 6, 0), (6, 6, 1)):
        mask = rng.random((h, w)) < share
        way = {(y, x) for y in range(h) for x in range(w) if not mask[y, x] and (y in (0, h - 1) or x in (0, w - 1))}
        new = way
        while new:
            new = {(v, u) for y, x in new for v, u in ((y, x - 1), (y, x + 1), (y - 1, x), (y + 1, x)) if 0 <= v < h and 0 <= u < w and not mask[v, u]} - way
            way = way | new
        want = np.array([[(y, x) not in way for x in range(w)] for y in range(h)])
        assert (K.fill_holes(mask) == want).all()


def pictures():
    rng = np.random.default_rng(7)
    y, x = np.mgrid[0:83, 0:131]
    noise = rng.integers(0, 256, (40, 33, 3)).astype(np.uint8)
    text = np.full((64, 300, 3), 255, dtype=np.uint8)
    text[20:40, ::7] = (10, 20, 200)
    return {1: np.stack([x * 1.9, y * 3, 255 - x], axis=2).clip(0, 255).astype(np.uint8), 2: noise, 3: text, 4: np.zeros((1, 1, 3), np.uint8), 5: np.full((600, 17, 3), 128, np.uint8), 6: rng.choice([0, 255], (64, 64, 3)).astype(np.uint8)}


def test_jpeg_is_read_by_another_decoder(spark, tmp_path):
    shown = pictures()
    pages = spark.createDataFrame([(k, p.shape[1], p.shape[0], p.tobytes()) for k, p in shown.items()] + [(9, 4, 4, None)], "page long, width int, height int, rgb binary")
    made = {r.page: r.jpeg for r in J.jpeg_pages(pages).collect()}
    assert made.pop(9) is None and set(made) == set(shown)
    for k, raw in made.items():
        (tmp_path / f"{k}.jpg").write_bytes(raw)
    far = {}
    for r in spark.read.format("image").load(f"file://{tmp_path}").select("image.*").collect():
        k = int(r.origin.split("/")[-1].split(".")[0])
        assert (r.width, r.height) == (shown[k].shape[1], shown[k].shape[0])
        plane = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, -1)[..., ::-1].astype(float)
        far[k] = np.sqrt(((plane - shown[k]) ** 2).mean())
    assert set(far) == set(shown) and max(far[k] for k in (1, 3, 4, 5)) < 4 and far[2] < 12 and far[6] < 25
    assert len(J.encode_jpeg(shown[1], 30)) < len(made[1]) / 2 < shown[1].size / 8


def test_code_lengths_are_complete_and_limited():
    weights = {i: 2**i for i in range(40)}
    lengths = J.code_lengths(weights)
    assert max(lengths.values()) == 16 and sum(2.0**-n for n in lengths.values()) == 1
    assert J.code_lengths({1: 5, 2: 1}) == {1: 1, 2: 1}


def test_request_bodies(spark):
    pages = spark.createDataFrame([(1, 'say "it"\n', b"\xff\xd8x" * 40)], "page long, prompt string, jpeg binary")
    parts, chat = (json.loads(pages.select(J.request_body(p, F.col("prompt"), F.col("jpeg"), "be brief", "m")).first()[0]) for p in ("gemini", "openai"))
    text, image = parts["contents"][0]["parts"]
    assert text == {"text": 'say "it"\n'} and base64.b64decode(image["inline_data"]["data"]) == b"\xff\xd8x" * 40
    assert parts["generationConfig"] == {"temperature": 0, "responseMimeType": "application/json"}
    assert chat["model"] == "m" and chat["temperature"] == 0 and chat["messages"][0] == {"role": "system", "content": "be brief"}
    assert "\n" not in chat["messages"][1]["content"][1]["image_url"]["url"]
    head, data = chat["messages"][1]["content"][1]["image_url"]["url"].split(",")
    assert head == "data:image/jpeg;base64" and base64.b64decode(data) == b"\xff\xd8x" * 40


def test_calls_overlap_in_order_and_are_bounded():
    lock, under, most, taken = threading.Lock(), 0, 0, 0

    def call(i):
        nonlocal under, most
        with lock:
            under += 1
            most = max(most, under)
        time.sleep(0.03 if i % 3 else 0.09)
        with lock:
            under -= 1
        if i % 10 == 7:
            raise ConnectionError(f"no {i}")
        return i * 2

    def items():
        nonlocal taken
        for i in range(40):
            taken += 1
            yield i

    began, got = time.time(), []
    for k, g in enumerate(C.in_order(items(), call, 4)):
        got.append(g)
        assert taken <= k + 6
    assert time.time() - began < 40 * 0.05 * 0.7 and most == 4
    assert got == [(None, f"ConnectionError: no {i}") if i % 10 == 7 else (i * 2, None) for i in range(40)]


def test_the_first_failure_stops_the_rest():
    begun = []

    def call(i):
        begun.append(i)
        if i == 3:
            raise ValueError("three")
        return i

    with pytest.raises(ValueError, match="three"):
        list(C.in_order(iter(range(1000)), call, 2, fail_fast=True))
    assert len(begun) < 10


def test_a_failure_is_a_row(spark):
    rows = spark.createDataFrame([(i, None if i == 4 else f"t{i}", "old") for i in range(9)], "id long, text string, Answer string")

    def call(row):
        if row["id"] == 5:
            raise ConnectionError("busy")
        return None if row["text"] is None else row["text"].upper()

    got = {r.id: (r.answer, r.error) for r in C.called(rows, ("id", "text"), call, tasks=2).collect()}
    assert got == {i: (None, "ConnectionError: busy") if i == 5 else (None if i == 4 else f"T{i}", None) for i in range(9)}
    with pytest.raises(Exception, match="busy"):
        C.called(rows, ("id", "text"), call, fail_fast=True).collect()
    assert C.called(rows.limit(0), ("id", "text"), call).columns == ["id", "text", "answer", "error"]
