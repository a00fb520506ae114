"""Calls of outside services for the rows of a table: several at once in a task, answers in order, a failure a row."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ADDED = ("answer", "error")


def in_order(items: Iterator, call: Callable, at_once: int = 4, fail_fast: bool = False) -> Iterator[tuple[object, str | None]]:
    """Answer and error of each item, in the order of the items, with at most ``at_once`` calls under way.

    No item is taken before there is a place for it, so any number of items needs the memory of ``at_once``. A call that raises
    has no answer and its error; with ``fail_fast`` that error is raised instead, and calls that have not begun are dropped.
    """
    at_once, waiting = max(1, at_once), deque()

    def done(f: Future) -> tuple[object, str | None]:
        try:
            return f.result(), None
        except Exception as e:  # a service's own errors are as many as services
            if fail_fast:
                raise
            return None, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(at_once) as pool:
        try:
            for item in items:
                if len(waiting) == at_once:
                    yield done(waiting.popleft())
                waiting.append(pool.submit(call, item))
            while waiting:
                yield done(waiting.popleft())
        finally:
            pool.shutdown(wait=True, cancel_futures=True)


def called(rows: DataFrame, inputs: tuple[str, ...], call: Callable[[dict], str | None], at_once: int = 4, fail_fast: bool = False, tasks: int | None = None) -> DataFrame:
    """``rows`` with ``answer`` and ``error`` of ``call`` on a dict of each row's ``inputs``.

    A task has ``at_once`` calls under way, and Spark as many tasks as it has cores; ``tasks`` states their number, so ``tasks * at_once`` is
    the most that a service sees. Other columns pass through untouched. With ``fail_fast`` the first failure fails the task, and by
    Spark's retries the job; without it a failure costs its row's answer alone. A task that runs again calls again. Columns named like
    an added one, in any case, are replaced. An empty table gives an empty result; nulls reach ``call`` as None.
    """
    kept = [c for c in rows.columns if c.lower() not in ADDED]
    wide = rows.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.struct(*[F.col(f"`{c}`") for c in inputs]).alias("said"))
    wide = wide.repartition(tasks) if tasks else wide
    schema = StructType([wide.schema["row"], *[StructField(c, StringType()) for c in ADDED]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = list(in_order((x.as_py() for x in b.column("said")), call, at_once, fail_fast))
            yield pa.RecordBatch.from_arrays([b.column("row"), *[pa.array([g[k] for g in got], pa.string()) for k in (0, 1)]], names=["row", *ADDED])

    return wide.mapInArrow(run, schema).select("row.*", *ADDED)
