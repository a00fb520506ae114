"""Sources, sinks of files, and streams."""

import os

import pytest
from pyspark.sql import functions as F

from folioflow.sources import files
from folioflow.streaming import events as E

EVENTS = "/root/testdata/sf0.001/events.parquet"


def test_files(spark, tmp_path):
    for name in ("a.PNG", "b.txt", "c.pdf"):
        (tmp_path / name).write_bytes(b"x")
    out = files.accepted(files.listed(spark, str(tmp_path))).collect()
    assert [r.kind for r in out] == ["pdf", "image"]
    (tmp_path / "d.pdf").write_bytes(b"x")
    with pytest.raises(Exception, match="more than one PDF"):
        files.accepted(files.listed(spark, str(tmp_path))).collect()


def test_image_pages(spark, tmp_path):
    header = b"BM" + (54 + 16).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (2).to_bytes(4, "little") + b"\x01\x00\x18\x00" + bytes(24)
    (tmp_path / "p.bmp").write_bytes(header + bytes([0, 0, 255, 0, 255, 0, 0, 0, 255, 0, 0, 255, 255, 255, 0, 0]))
    (tmp_path / "broken.bmp").write_bytes(b"BMnothing")
    row, = files.image_pages(spark, str(tmp_path)).collect()
    assert (row.width, row.height) == (2, 2) and bytes(row.rgb) == bytes([0, 0, 255, 255, 255, 255, 255, 0, 0, 0, 255, 0])  # rows are stored from the bottom


def test_glossary_file(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# x\r\nAlpha => 甲\r\n\r\nEpsilon\r\n")
    assert [(r.term, r.target, r.keep) for r in files.glossary_file(spark, str(tmp_path / "g.txt")).orderBy("no").collect()] == [("Alpha", "甲", False), ("Epsilon", "", True)]


def test_image_scale(spark):
    rows = spark.createDataFrame([(400, 200), (2000, 1000), (7600, 100)], "w int, h int")
    s = files.target_size(F.col("w"), F.col("h"))
    assert [(r.scale, r.width) for r in rows.select(*[c.alias(k) for k, c in s.items()]).collect()] == [(2.0, 800), (1.0, 2000), (0.5, 3800)]


@pytest.mark.skipif(not os.path.exists(EVENTS), reason="needs the driver's tables")
@pytest.mark.parametrize("window", [E.tumbling, E.sessions])
def test_stream_equals_batch(spark, tmp_path, window):
    whole = spark.read.parquet(EVENTS)
    whole = whole.select([F.col(f.split()[0]).cast(f.split()[1]) for f in E.SCHEMA.split(", ")])
    last = whole.agg(F.max("ts")).first()[0]
    closing = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), (F.lit(last) + F.expr("INTERVAL 9 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), F.lit(None).cast("string").alias("props"))
    src = str(tmp_path / "in")
    whole.orderBy("ts").coalesce(1).write.parquet(src)
    name = f"out_{window.__name__}"
    q = window(E.event_stream(spark, src)).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    closing.coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    got, want = spark.table(name), window(whole)
    assert got.count() == want.count() and got.agg(F.sum("n")).first() == want.agg(F.sum("n")).first()
