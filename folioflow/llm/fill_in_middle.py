"""Fill-in-the-middle transformation: DuckDB SQL over each Arrow batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._common import row_slices, text_of, without

ADDED = ("n", "form", "prefix_chars", "middle_chars", "output", "restored", "output_sha256", "restored_sha256")
TYPES = {"n": LongType(), "prefix_chars": LongType(), "middle_chars": LongType()}
#: Letters in a row are one unit, any other code point is one of its own.
UNITS = "[A-Za-z]+|[^A-Za-z]"


def middle_sql(source: str, seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> str:
    """DuckDB SQL over ``source`` (``id`` as text, ``text``) that makes the added columns, in the order of its rows.

    A marker in a text makes it plain, and none can arise where a piece meets a marker, so splitting an output at its markers
    gives the pieces back.
    """
    four = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))
    return f"""
WITH units AS (
  SELECT text, regexp_extract_all(text, '{UNITS}') AS unit, sha256('{seed}:' || id) AS h FROM {source}),
dealt AS (SELECT text, unit, len(unit) AS n, {four} FROM units),
cut AS (
  SELECT text, unit, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {plain_from} THEN 'plain'
              WHEN h4 % 100 < {spm_below} THEN 'spm' ELSE 'psm' END AS form
  FROM dealt),
pieces AS (
  SELECT text, n, form,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, 1, a), '') END AS prefix,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, a + 1, b), '') END AS middle,
         CASE WHEN form <> 'plain' THEN array_to_string(list_slice(unit, b + 1, n), '') END AS suffix
  FROM cut),
made AS (
  SELECT n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
         CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                   WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END AS output
  FROM pieces),
parts AS (SELECT *, CASE WHEN form <> 'plain' THEN string_split_regex(output, '<[PSM]>') END AS part FROM made),
back AS (
  SELECT *, CASE form WHEN 'psm' THEN part[2] || part[4] || part[3] WHEN 'spm' THEN part[3] || part[4] || part[2] ELSE output END AS restored
  FROM parts)
SELECT n, form, prefix_chars, middle_chars, output, restored, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256
FROM back"""


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output, restored`` and the two texts' digests.

    A whole text is cut into units at two places that its id alone decides, and its parts are rearranged around markers
    (``plain_from`` of 100 are left as they are from that number on, ``spm_below`` of 100 begin with the suffix). ``restored`` is
    made from ``output`` and ``form`` alone. Each slice of an Arrow batch is registered with a DuckDB of one thread in the
    worker; no row passes through Python.

    Defined cases: a null or empty text is plain and has no units; a text that holds a marker is plain; a null id is dealt as
    the empty string; very long texts are cut whole, in slices of some megabytes; repeated rows come out alike; all other columns
    pass through but for those named like an added one (in any case), which are replaced. An empty table gives an empty result.
    """
    carried = without(docs, *ADDED)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried.columns]).alias("row"), ident.alias("id"), text_of(F.col(f"`{text_col}`")).alias("text"))
    schema = StructType([rows.schema["row"], *[StructField(n, TYPES.get(n, StringType())) for n in ADDED]])
    wanted = pa.schema([(n, pa.int64() if n in TYPES else pa.string()) for n in ADDED])
    sql = middle_sql("batch", seed, plain_from, spm_below)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1}) as con:
            for part in row_slices(batches, "text"):
                con.register("batch", pa.Table.from_batches([part.select(["id", "text"])]))
                made = con.sql(sql).to_arrow_table().cast(wanted).combine_chunks()
                con.unregister("batch")
                columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made.columns]
                columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                yield pa.RecordBatch.from_arrays([part.column("row"), *columns], names=["row", *ADDED])

    return rows.mapInArrow(run, schema).select("row.*", *ADDED)
