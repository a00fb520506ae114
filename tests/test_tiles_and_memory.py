"""Tiles against uncut pages, crops against slices, terms against a scan place by place, and a memory over several runs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.operators import glossary as L
from folioflow.operators import kernels as K
from folioflow.operators import memory as M
from folioflow.operators import tiles as P


def pages(spark, planes):
    rows = [(i, p.shape[1], p.shape[0], bytearray(p.tobytes())) for i, p in enumerate(planes)]
    return spark.createDataFrame(rows, "page long, width int, height int, gray binary")


@pytest.fixture(scope="module")
def planes():
    rng = np.random.default_rng(5)
    noise = (rng.random((70, 90)) < 0.45).astype(np.uint8)
    spiral = np.zeros((64, 64), np.uint8)
    for k in range(0, 30, 4):
        spiral[k, k : 64 - k] = spiral[63 - k, k : 64 - k] = spiral[k : 64 - k, 63 - k] = spiral[k + 3 : 64 - k, k] = 1
    steps = np.eye(50, dtype=np.uint8)
    return [np.where(m, 0, 255).astype(np.uint8) for m in (noise, spiral, steps, np.zeros((20, 33), np.uint8), np.ones((40, 40), np.uint8))]


@pytest.mark.parametrize("reach", [0, 1])
@pytest.mark.parametrize("tile", [16, 32])
def test_components_of_tiles_are_those_of_the_page(spark, planes, reach, tile):
    got = P.components(P.plane_tiles(pages(spark, planes), tile), reach=reach, tile=tile).collect()
    want = [(i, c["x"], c["y"], c["w"], c["h"], c["area"]) for i, p in enumerate(planes) for c in K.components(p < 200, corners=bool(reach))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_crops_are_slices(spark, planes):
    rng = random.Random(3)
    boxes = [(i, n, rng.uniform(-5, p.shape[1]), rng.uniform(-5, p.shape[0]), rng.uniform(0, 60), rng.uniform(0, 60)) for i, p in enumerate(planes[:1]) for n in range(40)]
    got = P.crops(P.plane_tiles(pages(spark, planes[:1]), 16), spark.createDataFrame(boxes, "page long, no long, x double, y double, w double, h double"), 90, 70, pad=2, tile=16).collect()
    assert len(got) == 40
    for r in got:
        _, _, x, y, w, h = boxes[r.no]
        x0, y0 = min(max(int(np.floor(x - 2)), 0), 89), min(max(int(np.floor(y - 2)), 0), 69)
        x1, y1 = min(max(int(np.ceil(x + w + 2)), 0), 90), min(max(int(np.ceil(y + h + 2)), 0), 70)
        cut = planes[0][y0 : max(y1, y0 + 1), x0 : max(x1, x0 + 1)]
        assert (r.x, r.y, r.h, r.w) == (x0, y0, *cut.shape) and bytes(r.gray) == cut.tobytes()


def test_drawn_tiles_of_a_crowded_page(spark, monkeypatch):
    monkeypatch.setattr(P, "BOXES", 8)
    rng = random.Random(4)
    boxes = [(1, rng.randrange(50), rng.randrange(40), rng.randrange(0, 20), rng.randrange(0, 20), rng.randrange(255)) for _ in range(100)]
    plane = np.full((64, 96), 255, np.uint8)
    for _, x, y, w, h, shade in boxes:
        plane[y : y + h, x : x + w] = np.minimum(plane[y : y + h, x : x + w], shade)
    got = np.full_like(plane, 255)
    for r in P.drawn_tiles(spark.createDataFrame(boxes, "page long, x int, y int, w int, h int, shade int"), 32).collect():
        got[r.ty * 32 : r.ty * 32 + 32, r.tx * 32 : r.tx * 32 + 32] = np.frombuffer(r.gray, np.uint8).reshape(32, 32)
    assert (got == plane).all()


WORD = re.compile("[A-Za-z0-9_]")


def place_by_place(text, entries):
    """At each place the longest term whose ends stand at word boundaries, else the character."""
    terms = sorted(((t, to) for t, to, keep in entries if t and not keep), key=lambda e: -len(e[0]))
    out, i = "", 0
    while i < len(text):
        for t, to in terms:
            end = i + len(t)
            head = WORD.match(t[0]) and i and WORD.match(text[i - 1])
            tail = WORD.match(t[-1]) and end < len(text) and WORD.match(text[end])
            if text[i:end].lower() == t.lower() and not head and not tail:
                out, i = out + to, end
                break
        else:
            out, i = out + text[i], i + 1
    return out


def test_terms_against_a_scan_place_by_place():
    rng = random.Random(1)
    for k in range(1500):
        signs = "abAB_ -.(é" if k % 2 else "ab İ"
        entries = [("".join(rng.choice(signs) for _ in range(rng.randint(1, 4))).strip("İ"), f"<{j}>", rng.random() < 0.1) for j in range(8)]
        text = "".join(rng.choice(signs) for _ in range(30))
        assert L.Terms(entries).put(text) == place_by_place(text, entries), (text, entries)


def test_ten_thousand_terms(spark):
    rng = random.Random(2)
    entries = [(f"part {i}", f"#{i}", False) for i in range(10_000)] + [("part", "P", False)]
    lines = [f"PART {rng.randrange(12_000)}, part {rng.randrange(9_000)}x parts; a-part {rng.randrange(9)}." for _ in range(60)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(lines)), "k int, line string")
    got = {r.k: r.out for r in rows.select("k", L.apply_glossary(F.col("line"), entries).alias("out")).collect()}
    few = {re.sub(r"[x.,;]", "", w) for line in lines[:60] for w in line.split()}
    near = [e for e in entries if e[0] == "part" or e[0].split()[1] in few]
    assert all(got[k] == place_by_place(line or "", near) for k, line in enumerate(lines))
    hits = L.term_hits(rows, entries).where("k = 0").orderBy("start").collect()
    assert hits[0].start == 0 and lines[0][: hits[0].end].upper().startswith("PART")


class Counting:
    """An engine that says how often it was asked, through a Spark counter."""

    def __init__(self, counter, fails=()):
        self.counter, self.fails = counter, fails

    def __call__(self, texts):
        self.counter.add(len(texts))
        return [None if t in self.fails else f"[{t}]" for t in texts]


def test_memory_over_runs(spark, tmp_path):
    memory = M.Memory(spark, f"file://{tmp_path}/memory")
    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["one line", " one line ", "two", "three", "", None, "12"])], "no int, src string")
    asked = spark.sparkContext.accumulator(0)

    def run(entries=(), how=None, **kinds):
        before = asked.value
        out = M.translate_remembered(texts, list(entries), how or Counting(asked), memory, M.Run(**kinds)).select("no", "dst", "engine", "origin").collect()
        return {r.no: (r.dst, r.engine, r.origin) for r in out}, asked.value - before

    first, n = run(how=Counting(asked, fails=("three",)))
    assert n == 3 and first[0] == first[1] == ("[one line]", "engine", "engine") and first[3][1] == "failed" and first[6] == ("12", "skip", "rule")
    second, n = run()
    assert n == 1 and second[0] == ("[one line]", "engine", "memory") and second[3] == ("[three]", "engine", "engine")  # what failed is asked again
    third, n = run()
    assert n == 0 and len(memory.versions()) == 2 and third[3][2] == "memory"
    for other in ({"lang": "zh-TW"}, {"engine": "llm", "model": "m"}, {"codes": False}):
        assert run(**other)[1] == 3 and run(**other)[1] == 0
    assert run([("two", "zwei", False)])[1] == 3 and run([("two", "zwei", False)])[1] == 0 and run()[1] == 0
    rows = {tuple(r) for r in memory.read().collect()}
    whole = memory.fold()
    memory.prune()
    assert memory.versions() == [(whole, True)] and {tuple(r) for r in memory.read().collect()} == rows and run()[1] == 0


def test_memory_of_two_writers_and_a_dead_one(spark, tmp_path):
    memory = M.Memory(spark, f"file://{tmp_path}/shared")
    answers = lambda k, dst: spark.createDataFrame([(k, k, dst, "e", "")], M.SCHEMA)
    assert memory.publish(answers("a", "1")) == 1
    (tmp_path / "shared" / "_claim-00000002").touch()  # claimed by a writer that died
    (tmp_path / "shared" / "_waiting-dead").mkdir()
    assert memory.publish(answers("a", "2")) == 3 and memory.publish(answers("b", "1")) == 4
    assert sorted((r.key, r.dst) for r in memory.read().collect()) == [("a", "2"), ("b", "1")]
    assert memory.publish(spark.createDataFrame([], M.SCHEMA)) is None


def test_components_read_tiles_once(spark, planes):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    tiles = P.plane_tiles(pages(spark, planes), 16).localCheckpoint()
    got = P.components(tiles.mapInArrow(counted, P.TILES), tile=16).collect()
    want = [(i, c["x"], c["y"], c["w"], c["h"], c["area"]) for i, p in enumerate(planes) for c in K.components(p < 200)]
    assert seen.value == tiles.count() and sorted(map(tuple, got)) == sorted(want)


def test_boxes_of_a_tile_that_come_in_several_batches(spark, monkeypatch):
    monkeypatch.setattr(P, "SOME", 2)
    rng = random.Random(7)
    boxes = [(p, rng.randrange(-9, 80), rng.randrange(-9, 60), rng.randrange(1, 70), rng.randrange(1, 40), rng.randrange(255)) for p in (None, 1, 2) for _ in range(60)]
    want = {}
    for p, x, y, w, h, shade in boxes:
        for i in range(y, y + h):
            for j in range(x, x + w):
                tile = want.setdefault((p, i // 32, j // 32), np.full((32, 32), 255, np.uint8))
                tile[i % 32, j % 32] = min(tile[i % 32, j % 32], shade)
    drawn = P.drawn_tiles(spark.createDataFrame(boxes, "page long, x int, y int, w int, h int, shade int"), 32).collect()
    assert len(drawn) == len(want) and {(r.page, r.ty, r.tx): bytes(r.gray) for r in drawn} == {k: t.tobytes() for k, t in want.items()}
