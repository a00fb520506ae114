"""Sequential work on whole pages: a page's rows in one list, many pages in one Arrow batch."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only a session that runs in one process and names none (tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="folioflow-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """``df`` checkpointed: computed once and cut off from its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` as ``kept``, in compressed columns: for whole texts, of which a checkpoint would hold every byte."""
    path = f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """As many tasks as the session states: few bytes that cost much work are not folded into few of them."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def in_slices(df: DataFrame, column: str, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str, most: int = 4 << 20) -> DataFrame:
    """``work`` on runs of rows whose bytes in ``column`` are together about ``most``, a row at least: a worker never holds what a whole Arrow batch grows to."""
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64
            starts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // most, prepend=-1)).tolist()
            for start, end in zip(starts, [*starts[1:], b.num_rows], strict=False):
                yield pa.RecordBatch.from_pandas(work(b.slice(start, end - start).to_pandas()), schema=arrow, preserve_index=False)

    return df.mapInArrow(run, schema)


def lists(values: pa.Array) -> list:
    """A column as Python values, through NumPy where that says the same."""
    return values.to_numpy(zero_copy_only=False).tolist() if pa.types.is_primitive(values.type) and not values.null_count and not pa.types.is_temporal(values.type) else values.to_pylist()


def per_page(df: DataFrame, columns: tuple[str, ...], order: tuple[str, ...], work: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``work`` on the rows of each page, sorted by ``order``; its rows get the page back as ``page``.

    A batch of pages costs one call of Python, not one a page, and the number of partitions is stated, so a small table with
    heavy work is not folded into one task.
    """
    spark = df.sparkSession
    listed = df.repartition(tasks(spark), "page").groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in columns if c not in order]))).alias("rows"))
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch["rows"]
            flat = listed.flatten()
            names = [f.name for f in flat.type]
            rows = [dict(zip(names, r)) for r in zip(*map(lists, flat.flatten()))]
            ends = np.cumsum(listed.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            out, pages = [], []
            for page, start, end in zip(batch["page"].to_pylist(), [0, *ends], ends):
                found = work(rows[start:end])
                out += found
                pages += [page] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(pages if f.name == "page" else [r.get(f.name) for r in out], f.type) for f in arrow], schema=arrow)

    return listed.mapInArrow(run, schema)
