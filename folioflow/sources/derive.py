"""Domain relations made from the driver's tables, with the same definitions as SQL for a second engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a page and its lines are boxes; all numbers are whole."""
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.row_number().over(order).cast("int").alias("no"),
        ((F.col("l_partkey") % 97) * 10).cast("double").alias("x"), ((F.col("l_suppkey") % 41) * 12).cast("double").alias("y"),
        (20 + 3 * F.floor("l_quantity")).cast("double").alias("w"), (8 + 2 * F.col("l_linenumber")).cast("double").alias("h"),
        F.concat(F.lit("item "), F.col("l_partkey") % 50).alias("src"),
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("")).otherwise(F.concat(F.lit("dst"), F.col("l_partkey") % 7)).alias("dst"),
    )


BOXES = """boxes AS (SELECT l_orderkey AS page,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS INTEGER) AS no,
  CAST((l_partkey % 97) * 10 AS DOUBLE) AS x, CAST((l_suppkey % 41) * 12 AS DOUBLE) AS y,
  CAST(20 + 3 * floor(l_quantity) AS DOUBLE) AS w, CAST(8 + 2 * l_linenumber AS DOUBLE) AS h,
  'item ' || (l_partkey % 50) AS src,
  CASE WHEN l_suppkey % 3 = 0 THEN '' ELSE 'dst' || (l_partkey % 7) END AS dst FROM lineitem)"""


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", "lang", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))


LINES = r"""lines AS (SELECT doc_id, lang, CAST(unnest(range(len(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))))) AS INTEGER) AS line_no,
  unnest(string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10))) AS line FROM documents)"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as an 8 x 8 page of pixels: (page, y, x, lum, r, g, b)."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("i", "v"))
    lum = F.least(F.greatest(F.floor((F.col("v").cast("double") + 0.6) * 200), F.lit(0)), F.lit(255)).cast("int")
    p = e.select("page", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).cast("int").alias("x"), lum.alias("lum"))
    return p.withColumns({"r": F.col("lum"), "g": (F.col("lum") * 7 + F.col("x") * 13) % 256, "b": (F.col("lum") * 3 + F.col("y") * 5) % 256})


PLANES = """emb AS (SELECT vec_id AS page, unnest(range(64)) AS i, unnest(embedding) AS v FROM embeddings),
q AS (SELECT page, CAST(i // 8 AS INTEGER) AS y, CAST(i % 8 AS INTEGER) AS x, CAST(least(greatest(floor((CAST(v AS DOUBLE) + 0.6) * 200), 0), 255) AS INTEGER) AS lum FROM emb),
planes AS (SELECT *, lum AS r, (lum * 7 + x * 13) % 256 AS g, (lum * 3 + y * 5) % 256 AS b FROM q)"""

#: Awkward texts that join the documents' own lines.
SAMPLES = (
    '"Front"', "- Front:", '3.5"', '12" x 8"', "• Back —", "“EMBROIDERY”", "PMS 1234 C", "45 in", "100%", "SEPARATE PIECE", "SEPARRTE PIECE", "材质规格",
    "a long sentence about many things", "SKU-11227J", "|||||", "###", "xzqwrt", "A", "", "4'5\" and 160cm, 65%", "of/fice /fire /_/ tra/ffl", "中文 ， 已存在 （ 好 ）", "１２３ and 45", "AB-1234 costs 99", "Material", "Hello there world",
)


def samples(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(SAMPLES)), "no int, line string")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


SAMPLE_ROWS = "samples(no, line) AS (VALUES " + ", ".join(f"({i}, {_quoted(s)})" for i, s in enumerate(SAMPLES)) + ")"
