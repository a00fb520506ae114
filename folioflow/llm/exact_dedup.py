"""Exact de-duplication by a 128-bit content hash with a byte comparison inside each hash group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import BLANKS, one_of_each, rows_of, text_of, without, written

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """``docs`` with ``keep_id, group_size, kept, text_sha256``.

    Texts are equal when the same bytes remain after deleting spaces and the control characters
    9 to 13. Of equal texts the row with the most code points in the original text stays, then the
    smallest id. One pass groups by (128-bit hash, bytes): the hash routes and orders the rows, the
    bytes decide, so colliding texts never share a group. Equal texts are combined before the
    shuffle, so a text that a third of all rows share costs one row per task. A second pass attaches
    the group to every row by hash alone; rows of hashes that several texts share (normally none)
    are matched by their bytes.

    Defined cases: null text counts as empty, and all empty or blank texts form one group. A null id
    loses every tie and is ``kept`` only if its whole group has null ids. A row is ``kept`` that has the group's ``keep_id`` and as many
    code points as the row that stays, so full repeats of that row are all marked (``keep_first_copies`` keeps one of them).
    An empty table gives an empty result. Columns of ``docs`` named like an added one are replaced; others pass through.
    """
    out, base = _grouped(docs, id_col, text_col, digest)
    return out.select(*[F.col(f"`{c}`") for c in base.columns], *ADDED)


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    norm, points, ident = F.translate(text_of(text_col), BLANKS, ""), F.length(text_of(text_col)), F.col(f"`{id_col}`")
    rows = docs.select(ident.alias("id"), points.alias("points"), norm.alias("norm")).withColumn("h", digest("norm"))
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("no_id"), F.col("id").alias("id"))).alias("best")
    found = [F.sha2("norm", 256).alias("text_sha256"), "group_size", F.col("best.id").alias("keep_id"), (-F.col("best.less")).alias("__most")]
    groups = written(rows.groupBy("h", "norm").agg(F.count("*").alias("group_size"), best).select(F.col("h").alias("__h"), *found), "exact-groups")
    base = without(docs, *ADDED, "__h", "__norm", "__points", "__most")
    keyed = base.withColumn("__h", digest(norm)).withColumn("__points", points)
    shared = groups.groupBy("__h").agg(F.count("*").alias("__texts")).where("__texts > 1").drop("__texts")
    if shared.isEmpty():
        out = keyed.join(groups, "__h")
    else:
        shared = written(shared, "exact-collisions")
        in_bytes = keyed.join(shared, "__h", "left_semi").withColumn("__norm", norm)
        their = rows.withColumnRenamed("h", "__h").join(shared, "__h", "left_semi").groupBy("__h", "norm").agg(F.count("*").alias("group_size"), best)
        their = their.select("__h", F.col("norm").alias("__norm"), *found)
        plain = keyed.join(shared, "__h", "left_anti").join(groups.join(shared, "__h", "left_anti"), "__h")
        out = plain.unionByName(in_bytes.join(their, ["__h", "__norm"]).drop("__norm"))
    return out.withColumn("kept", ident.eqNullSafe(F.col("keep_id")) & (F.col("__points") == F.col("__most"))), base


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row of each group, the one that ``exact_dedup`` keeps, with all columns of ``docs`` as they were.

    Of full repeats of that row any one stays: ids and text lengths are counted by hash first, without texts, and only
    rows that are repeated there are exchanged to keep one.
    """
    slim = rows_of(docs, id_col, text_col)
    kept = _grouped(slim, id_col, text_col, digest)[0].where("kept")
    norm = F.translate(text_of(text_col), BLANKS, "")
    again = slim.groupBy(F.col(f"`{id_col}`").alias("i"), digest(norm).alias("h"), F.length(text_of(text_col)).alias("p")).agg(F.count("*").alias("n")).where("n > 1")
    again = written(again.select("h").distinct(), "exact-repeats")
    if again.isEmpty():
        return kept.select("__row.*")
    marked = kept.join(again.select(F.col("h").alias("__h"), F.lit(True).alias("__tied")), "__h", "left")
    return one_of_each(marked.withColumn("__tied", F.coalesce("__tied", F.lit(False))), "text_sha256", "__tied")
