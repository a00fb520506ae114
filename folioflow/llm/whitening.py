"""Whitening of embeddings: covariances from upper-triangle column aggregates, decomposed with LAPACK."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, written

ADDED = ("component", "n", "deviation", "whitened", "explained", "identity_error")
#: The integers that entries become: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: An eigenvalue of less than this part of the largest cannot be told from rounding; its component has no unit variance.
LEAST = 1e-12


def covariance(table: DataFrame, columns: list[str], means: list[float], n: int) -> np.ndarray:
    """The covariance of double columns, centred before multiplying, divisor ``n``: one aggregation of a sum for each pair."""
    centred = table.select([(F.col(c) - F.lit(float(m))).alias(f"c{i}") for i, (c, m) in enumerate(zip(columns, means, strict=True))])
    k = len(columns)
    sums = centred.selectExpr(*[f"sum(c{i} * c{j}) AS s{i}_{j}" for i in range(k) for j in range(i, k)]).first()
    out = np.zeros((k, k))
    out[np.triu_indices(k)] = np.array(list(sums), dtype="f8")
    return (out + np.triu(out, 1).T) / n


def integers(vectors: Column) -> Column:
    """Null for a vector that is null or empty or holds an entry that is no finite number, else its entries as integers."""
    entries = F.transform(vectors, lambda c: c.cast("double"))
    sound = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    return F.when((F.size(vectors) > 0) & sound, F.transform(entries, lambda c: F.floor(c * SCALE).cast("long") + F.lit(SHIFT).cast("long")))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", most: int = 16) -> DataFrame:
    """One row for each sound vector and component: ``id_col, component, n, deviation, whitened, explained, identity_error``.

    Entries become integers, and statistics are those of the fit list, each distinct integer vector once: exact sums, then the
    covariance from one sum a pair of dimensions, generated as Spark SQL, of products of centred entries. Its unit eigenvectors (LAPACK,
    on the driver, from as many numbers as there are pairs) are the components, by falling eigenvalue; the first ``most`` are
    kept. ``whitened`` is the centred vector's projection over the square root of the eigenvalue, and ``identity_error`` the largest
    absolute entry of the covariance of the fit list's whitened vectors minus the identity, aggregated in the same way.

    Equal vectors are combined before the shuffle, and again none is expanded into pairs. Of the rows only sums reach the driver.

    Defined cases: vectors that are null, empty or hold null or non-finite entries are dropped; so are those of another length than
    the commonest (of ties, the longest). Null and repeated ids stay as they are. A component whose eigenvalue is not above
    rounding has a null ``whitened`` and takes no part in ``identity_error``, which is null where all are such (one distinct vector);
    ``explained`` is null where there is no variance at all. Integers or deviations beyond 64 bits are an error (ANSI arithmetic).
    Other columns are not carried, so clashing names do no harm. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col(f"`{id_col}`").alias("id"), integers(F.col(f"`{vec_col}`")).alias("x")).where("x IS NOT NULL")
    lengths = sound.groupBy(F.size("x").alias("k")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("k")).first()
    if lengths is None:
        return spark.createDataFrame([], _schema(vectors, id_col))
    k = lengths["k"]
    sound = sound.where(F.size("x") == k)
    fit = written(sound.select("x").distinct().select([F.col("x")[i].alias(f"x{i}") for i in range(k)]), "whitening-fit")
    names = fit.columns
    total = fit.selectExpr("count(*) AS n", *[f"sum({c}) AS {c}" for c in names]).first()
    n, sums = total["n"], [total[c] for c in names]
    means = [s / n for s in sums]
    values, vectors_ = np.linalg.eigh(covariance(fit.select([F.col(c).cast("double").alias(c) for c in names]), names, means, n))
    values, axes = values[::-1], vectors_[:, ::-1]
    trace = float(values.sum())
    values, axes = values[:most], axes[:, :most]
    told = values > LEAST * max(values[0], 0.0)
    root = np.sqrt(np.where(told, values, 1.0))
    centre = np.array(means)

    def project(x: np.ndarray) -> np.ndarray:
        return (x - centre) @ axes / root

    def of_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame(project(b.to_numpy(dtype="f8")), columns=[f"w{i}" for i in range(len(root))])

    error = None
    if told.any():
        white = fit.mapInPandas(of_fit, ", ".join(f"w{i} double" for i in range(len(root)))).select([f"w{i}" for i in np.flatnonzero(told)])
        error = float(np.abs(covariance(white, white.columns, [0.0] * len(white.columns), n) - np.eye(len(white.columns))).max())
    discard(fit)

    def of_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            x = np.array(b["x"].tolist(), dtype="f8").reshape(len(b), k)
            yield b[["row", "deviation"]].assign(w=list(np.where(told, project(x), np.nan)))

    # n and S as literals: exact integers, multiplied and added as longs
    sums_array = F.array(*[F.lit(s).cast("long") for s in sums])
    deviation = F.aggregate(F.zip_with("x", sums_array, lambda x, s: F.lit(n).cast("long") * x - s), F.lit(0).cast("long"), lambda a, d: a + d * d)
    rows = sound.select(F.struct("id").alias("row"), "x", deviation.alias("deviation"))
    row_type = rows.schema["row"].dataType.simpleString()
    out = rows.mapInPandas(of_rows, f"row {row_type}, deviation long, w array<double>").select("row.id", "deviation", F.posexplode("w").alias("at", "w"))
    share = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    return out.select(
        F.col("id").alias(id_col), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.nanvl("w", F.lit(None).cast("double")).alias("whitened"),
        share[F.col("at")].alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def _schema(vectors: DataFrame, id_col: str):
    from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

    types = {"component": IntegerType(), "n": LongType(), "deviation": LongType()}
    return StructType([StructField(id_col, vectors.schema[id_col].dataType), *[StructField(c, types.get(c, DoubleType())) for c in ADDED]])
