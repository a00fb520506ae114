"""What must not grow with the tables: rows a task holds, tasks a small table is folded into, files a driver lists."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioflow.operators import pages as O
from folioflow.plans import queries as Q
from folioflow.sources import pdf as P

SF = "/root/testdata/sf0.001"


def test_written_files_are_read_by_name(spark, tmp_path):
    rows = [(str(b), p, 100.0, 50.0, [(1.0, 9.0, 8.0, None, f"page {b} {p}")]) for b in range(9) for p in (1, 2)]
    pages = spark.createDataFrame(rows, f"doc string, page_no long, width_pt double, height_pt double, items {P.LAYER}")
    pages = pages.withColumns({"width": F.lit(None), "height": F.lit(None), "rgb": F.lit(None).cast("binary")})
    folder = f"file://{tmp_path}/books"
    files = P.write_pdfs(pages, folder)
    named = P.read_pdfs(spark, folder, files)
    assert named.rdd.getNumPartitions() == O.tasks(spark)
    assert not any(str(tmp_path) in f for f in named.inputFiles())
    said = lambda df: sorted((r.path.rsplit("/", 1)[1], r.page_no, r["items"][0].str, r.error) for r in df.collect())
    assert said(named) == said(P.read_pdfs(spark, folder)) and len(said(named)) == 18


@pytest.mark.parametrize("raw", [b"12", b"-3", b"+4.5", b".5", b"7.", b"1 0 R", b"1 0 Rx", b"<0aF1>", b"<0a f>", b"Tj", b"true", b"12abc", b"%c\r\n 5", b"[1 % gone\n 2]", b"% 1 0 R", b"1.2.3", b"T*", b"'", b"[1 0 R 2]", b"<</A 1>>"])
def test_tokens_in_one_match_equal_those_step_by_step(raw, monkeypatch):
    from folioflow.sources import pdf_syntax as S

    def every():
        r, out = S.Reader(raw + b" "), []
        while (x := r.next()) is not None:
            out.append((type(x), x))
        return out

    quick = every()
    monkeypatch.setattr(S, "TOKEN", S.re.compile(rb"(?!)"))
    assert quick == every()


def test_work_gets_slices_of_stated_bytes(spark):
    df = spark.range(100, numPartitions=1).withColumn("raw", F.when(F.col("id") % 10 != 3, F.repeat(F.lit("x"), 1000).cast("binary")))

    def work(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"id": part["id"], "held": len(part)})

    got = O.in_slices(df, "raw", work, "id long, held int", 10_000).toPandas()
    assert sorted(got["id"]) == list(range(100)) and got["held"].max() <= 13
    assert O.in_slices(df.where("id < 0"), "raw", work, "id long, held int").count() == 0


def test_page_images_are_not_folded_into_one_task(spark):
    assert Q._plane_rows(spark, SF).rdd.getNumPartitions() == O.tasks(spark)


def test_layouts_of_equal_texts_are_made_once_and_placed_apart(spark):
    from folioflow.operators import layout as Y

    rows = [(f"item {i % 5}, and more", float(i), float(3 * i), 20.0 + i % 4, 9.0 + i % 3, None if i % 2 else 14.0, None) for i in range(200)] + [(None, 1.0, 2.0, 30.0, 10.0, None, 50.0), ("x" * 90, 0.0, 0.0, 40.0, 12.0, 99.0, None)]
    items = spark.createDataFrame(rows, "text string, x double, y double, w double, h double, allow_h double, allow_w double")
    Y._shaped.cache_clear()
    want = [Y.fit(t or "", *v, Y.Limits(allow_h=a, allow_w=b)) for t, *v, a, b in rows]
    assert Y._shaped.cache_info().misses <= 5 * 4 * 3 * 2 + 1
    got = Y.lay_out(items.coalesce(1)).select("layout.*").collect()
    assert [{k: r[k] for k in Y.FIELDS} for r in got] == [{k: w[k] for k in Y.FIELDS} for w in want]


def test_tiles_come_in_slices(spark, monkeypatch):
    from folioflow.operators import tiles as P2

    boxes = spark.createDataFrame([(p, p * 7 % 900, p * 13 % 600, 150, 9, 40) for p in range(300)], "page long, x int, y int, w int, h int, shade int")
    whole = P2.components(P2.drawn_tiles(boxes).localCheckpoint(), level=P2.PAPER).collect()
    monkeypatch.setattr(P2, "SOME", 3)
    parts = P2.drawn_tiles(boxes).localCheckpoint()
    assert sorted(P2.components(parts, level=P2.PAPER).collect()) == sorted(whole)
    marks = boxes.withColumn("no", F.lit(1).cast("long"))
    crops = P2.crops(parts, marks, 1050, 700, pad=1).collect()
    assert len(crops) == 300 and all(r["gray"].count(40) == 150 * 9 for r in crops)


def test_one_language_is_numbered_by_many_tasks(spark):
    from folioflow.operators import glossary as L

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # few rows would share a task else
    rows = [("en", f"text {i * 7919 % 3000:05d}") for i in range(3000)] + [(None, f"t{i}") for i in range(30)] + [("de", "a")]
    got = L.request_batches(spark.createDataFrame(rows, "lang string, raw string"), 24).withColumn("at", F.spark_partition_id()).collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r["at"] for r in got if r["lang"] == "en"}) > 1
    want = {(lang, raw): i // 24 for lang in ("en", None, "de") for i, raw in enumerate(sorted(r for g, r in rows if g == lang))}
    assert {(r["lang"], r["raw"]): r["batch"] for r in got} == want and len(got) == len(rows)


def test_fnv1a_of_many_texts_equals_a_loop():
    from folioflow.functions import text as T

    rng = np.random.default_rng(3)
    texts = ["", "a", "𝄞 and 中文", *("".join(map(chr, rng.integers(32, 0x2FFFF, n, dtype=int))) for n in rng.integers(0, 60, 80))]
    texts = ["".join(c for c in t if not 0xD800 <= ord(c) < 0xE000) for t in texts] + ["long " * 5000]

    def plain(t: str) -> int:
        h, raw = 2166136261, t.encode("utf-16-le")
        for i in range(0, len(raw), 2):
            h = ((h ^ int.from_bytes(raw[i : i + 2], "little")) * 16777619) & 0xFFFFFFFF
        return h

    assert T.fnv1a_all(texts) == list(map(plain, texts)) and T.fnv1a_all([]) == []


def test_rows_of_a_page_come_as_they_are(spark):
    rows = [(1, 2, None, "b"), (1, 1, 2.5, None), (None, 3, 1.0, "c"), (2, 1, 4.0, "d")]
    df = spark.createDataFrame(rows, "page long, no int, x double, s string")
    got = O.per_page(df, ("x", "s"), ("no",), lambda rows: [r | {"n": len(rows)} for r in rows] if rows[0]["x"] != 4.0 else [], "page long, no int, x double, s string, n int")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 1, 2.5, None, 2), (1, 2, None, "b", 2), (None, 3, 1.0, "c", 1)], key=str)


def test_memory_moves_keys_and_not_texts(spark, tmp_path):
    from folioflow.operators import memory as M

    texts = spark.createDataFrame([(i, f"{i} " + "words of a long line " * 50) for i in range(300)] * 2, "no int, src string")
    memory = M.Memory(spark, f"file://{tmp_path}/memory")
    run = lambda t: {(r.no, r.dst, r.origin) for r in M.translate_remembered(t, [], lambda b: [f"[{x}]" for x in b], memory).collect()}
    assert {o for *_, o in run(texts.where("no < 250"))} == {"engine"}
    again = run(texts)
    assert len(again) == 300 and all((o == "memory") == (no < 250) and d.startswith("[") for no, d, o in again)
    assert len(memory.versions()) == 2 and {len(r.key) for r in memory.read().collect()} == {24}
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    kept = {r.id for r in M._maybe(keys, keys.where("id % 50 = 7").select("key")).collect()}
    assert kept >= set(range(7, 5000, 50)) and len(kept) < 200


def test_folds_normalise_each_text_once(spark):
    from folioflow.operators import boxes as B

    rows = spark.createDataFrame([(1, 1, 0.0, 0.0, 9.0, 9.0, "Front  piece", "", 50.0), (1, 2, 1.0, 0.0, 9.0, 9.0, "FRONT piece", "x", 60.0)], "page long, no int, x double, y double, w double, h double, src string, dst string, conf double")
    for df in (B.dedupe_same_text(rows), B.drop_reread(rows.withColumnRenamed("src", "text"))):
        assert df._jdf.queryExecution().analyzed().toString().count("[‘’“”]") == 1
        assert df.count() == 1


@pytest.mark.parametrize("mode", ["smart", "whole"])
def test_items_are_prepared_in_one_pass(spark, mode):
    from folioflow.operators import boxes as B

    rng = np.random.default_rng(5)
    rows = [(int(p), int(no), float(rng.integers(0, 60)), float(rng.integers(0, 40)), float(rng.integers(0, 40)), float(rng.integers(0, 20)), ["a", None, "", "b c"][rng.integers(4)], ["", None, "d", "中文"][rng.integers(4)]) for p in range(80) for no in rng.permutation(9)]
    items = spark.createDataFrame(rows, "page long, no int, x double, y double, w double, h double, src string, dst string")
    got = B.prepare_items(items, mode)
    merged = B.merge_adjacent(B.dedupe_overlapping(items).drop("pos"), **({"gap_ratio": float("inf")} if mode == "whole" else {})).drop("merged")
    want = B.collapse_overlapping(B.dedupe_overlapping(merged).drop("pos")).drop("pos")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
    assert got._jdf.queryExecution().analyzed().toString().count("collect_list") == 1
