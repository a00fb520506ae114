"""What the corpus operators share: reading, stage boundaries, name clashes."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Fixed value: the six characters of [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
#: Paths of written tables that nobody has discarded yet.
_LEFT: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a session that runs in one process (a local master, as in tests) and names none gets a folder of its own; on a
    cluster a missing setting is an error, as executors could not see such a folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='folioflow-')}"
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
    return found.rstrip("/")


def written(df: DataFrame, tag: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts lineage: a lost executor costs only the tasks that read the written table. An empty
    result keeps its schema. No _SUCCESS file: nobody asks for it, and where Hadoop has no native library
    the driver forks a process for each folder or file that it makes.
    """
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _LEFT.add(path)
    _local_folders(df.sparkSession, path)
    df.write.mode("append").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folioflow_path = path
    return out


def _local_folders(spark: SparkSession, path: str) -> None:
    """Make the folders of a write to a mounted folder, the table's and its committer's (``_temporary/0``, gone after the commit).

    Otherwise Hadoop without its native library forks the driver for each of the three, to set permissions, and a
    fork shares all memory of the driver until its program starts. Other stores need none of this.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        os.makedirs(f"{p.toUri().getPath()}/_temporary/0", exist_ok=True)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _LEFT.discard(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``written`` that no later step reads."""
    for df in tables:
        delete(df.sparkSession, df._folioflow_path)


@atexit.register
def _discard_rest() -> None:
    """Results are lazy and may read the last tables of their operator, so these live as long as the driver's session."""
    spark = SparkSession.getActiveSession()
    for path in list(_LEFT) if spark is not None else ():
        delete(spark, path)


def rows_of(docs: DataFrame, *needed: str) -> DataFrame:
    """The columns that an operator reads, and whole rows as ``__row``: no name of the caller's can clash with an added one."""
    return docs.select(*[F.col(f"`{c}`") for c in needed], F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"))


def one_of_each(rows: DataFrame, key: str, tied: str) -> DataFrame:
    """One row a ``key`` among the rows that are ``tied`` (boolean), and all others, as they were in ``__row``.

    Only tied rows, full repeats of a row, are exchanged; copies are combined before that.
    """
    again = rows.where(tied).dropDuplicates([key])
    return rows.where(f"NOT {tied}").unionByName(again).select("__row.*")


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` minus columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def text_of(column: str | Column) -> Column:
    """A text column with null as the empty string."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def held_out(doc_id: Column) -> Column:
    """True for the fifth of ids that no classifier may learn from (crc32 of the id as text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def row_slices(batches: Iterator[pa.RecordBatch], column: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows whose texts in ``column`` have together about ``most`` bytes, a row at least; none is empty."""
    for b in batches:
        lengths = pc.binary_length(b.column(column)).to_numpy(zero_copy_only=False) + 64
        run = (np.cumsum(lengths) - lengths) // most
        starts = np.flatnonzero(np.diff(run, prepend=-1))
        for start, end in zip(starts, [*starts[1:], b.num_rows], strict=True):
            yield b.slice(int(start), int(end - start))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of whole texts small: long texts, not row counts, fill a Python worker."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def with_scores(docs: DataFrame, carry: list[str], inputs: list[Column], score: Callable[[pd.DataFrame], list[np.ndarray]], names: list[str]) -> DataFrame:
    """The columns ``carry`` of ``docs`` and a double column for each of ``names``, computed from batches of ``inputs``.

    What is carried goes through the worker as Arrow data that nobody looks at, so its types and nulls stay as they are.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), *inputs)
    schema = StructType([rows.schema["row"], *[StructField(n, DoubleType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = score(b.select(b.schema.names[1:]).to_pandas()) if b.num_rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(np.asarray(x, dtype="f8")) for x in found]], names=["row", *names])

    return rows.mapInArrow(run, schema).select("row.*", *names)
