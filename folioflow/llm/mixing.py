"""Mixing sources to target weights with cube-method balanced sampling."""

from __future__ import annotations

import math
import random

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, rows_of, text_of, without, written

WORDS = r"[^\x20\x09-\x0D]+"
#: Units that one task balances at a time.
BLOCK = 2048
EPS = 1e-9
ADDED = ("size", "source_size", "target", "copies", "taken")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> dict[str | None, float]:
    """Words wanted from each source: the total shared by weight (sources by code point, null last,
    weights repeating), none above ``most`` times its size; what is cut off is shared again by weight.

    The law for a handful of sources; ``source_targets`` applies it to a table of any length.
    """
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = float(sum(sizes.values())), {}
    while True:
        open_ = [s for s in order if s not in capped]
        share = (total - sum(capped.values())) / sum(weight[s] for s in open_) if open_ else 0.0
        over = [s for s in open_ if share * weight[s] > most * sizes[s]]
        if not over:
            return capped | {s: share * weight[s] for s in open_}
        capped |= {s: most * sizes[s] for s in over}


def source_targets(rows: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """A written table ``source, src, source_size, target, whole, part`` with a row a source of ``rows`` (source, words).

    Sources are numbered in order by one range exchange and running counts of its tasks, so there may be as many as hosts of a crawl;
    each round of the re-sharing brings two sums to the driver. ``whole`` copies of every document are certain,
    ``part`` is the chance of one more.
    """
    per = rows.groupBy("source").agg(F.sum("words").alias("source_size"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    last, name = F.col("source").isNull(), F.coalesce("source", F.lit(""))
    order = per.select("*", last.alias("last"), name.alias("name")).repartitionByRange(tasks, "last", "name").sortWithinPartitions("last", "name")
    order = written(order.select("source", "source_size", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row")), "mix-sources")
    before, running = {}, 0
    for r in sorted(order.groupBy("task").agg(F.min("row").alias("first"), F.count("*").alias("n")).collect()):  # a row a task
        before[r["task"]] = running - r["first"]
        running += r["n"]
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(sorted(before.items()) or [(0, 0)], "task int, offset long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("src") % len(weights) + 1).cast("int"))
    table = order.join(offsets, "task").select("source", "source_size", (F.col("row") + F.col("offset")).alias("src")).withColumn("weight", weight)
    table = written(table, "mix-numbered")
    size, share, cut = F.col("source_size").cast("double"), 0.0, F.lit(False)
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    while True:
        free = table.agg(F.sum(F.when(cut, most * size).otherwise(0.0)).alias("capped"), F.sum(F.when(cut, 0.0).otherwise(F.col("weight"))).alias("open")).first()
        if not free["open"]:
            break
        share = (total - free["capped"]) / free["open"]
        # A capped source stays capped: its share only grows, and what was cut off of it is shared among the others.
        over = share * F.col("weight") > most * size
        if table.where(over & ~cut).isEmpty():
            break
        cut = over
    target = F.when(cut, most * size).otherwise(share * F.col("weight"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / size).otherwise(0.0)
    whole = F.least(F.lit(int(most)), F.floor(ratio + EPS)).cast("int")
    part = F.when(F.col("whole") < most, F.greatest(F.lit(0.0), ratio - F.col("whole"))).otherwise(0.0)
    out = table.withColumn("target", target).withColumn("whole", whole).withColumn("part", F.when(part < EPS, 0.0).otherwise(part))
    out = written(out.select("source", "src", "source_size", "target", "whole", "part"), "mix-targets")
    discard(order, table)
    return out


def _step(p: list[float], who: list[int], u: tuple[float, ...], rng: random.Random) -> None:
    """Move ``p`` along ``u`` to a face of the cube, up or down so that expectations stay."""
    up = min(((1 - p[i]) / x if x > 0 else p[i] / -x) for i, x in zip(who, u, strict=True) if x)
    down = min((p[i] / x if x > 0 else (1 - p[i]) / -x) for i, x in zip(who, u, strict=True) if x)
    by = up if rng.random() * (up + down) < down else -down
    for i, x in zip(who, u, strict=True):
        v = p[i] + by * x
        p[i] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v


def flight(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Flight phase: the totals of p and of p * size stay; at most two entries stay fractional.

    Three fractional units at a time move along the null vector of their two constraints.
    """
    p, live = list(p), []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        live.append(i)
        while len(live) == 3:
            a, b, c = (size[k] for k in live)
            u = (c - b, a - c, b - a)
            if not any(u):
                u = (1.0, -1.0, 0.0)
            else:
                most = max(map(abs, u))
                u = tuple(x / most for x in u)
            _step(p, live, u, rng)
            live = [k for k in live if 0 < p[k] < 1]
    return p


def landing(p: list[float], size: list[float], rng: random.Random) -> list[float]:
    """Land what is still fractional: give up the count and keep the words, round the last unit to the nearer end, then settle
    the words that this missed by turning over settled units, largest first, as long as one brings the total nearer."""
    p, movable = list(p), sorted(range(len(p)), key=lambda i: -size[i])
    want = math.fsum(x * s for x, s in zip(p, size, strict=True))
    while len(live := [i for i in movable if 0 < p[i] < 1]) > 1:
        a, b = live[:2]
        top = size[a]
        _step(p, [a, b], (size[b] / top, -1.0) if size[b] else (0.0, 1.0), rng)
    p = [x if x in (0.0, 1.0) else float(x >= 0.5) for x in p]
    miss = want - math.fsum(x * s for x, s in zip(p, size, strict=True))
    for i in movable:
        sign = 1.0 if miss > 0 else -1.0
        if p[i] == (miss < 0) and abs(miss - sign * size[i]) < abs(miss):
            p[i], miss = 1.0 - p[i], miss - sign * size[i]
    return p


_UNITS = "id long, h long, src long, size double, p double"


def _balance(last: bool, seed: int):
    def run(key: tuple, units: pd.DataFrame) -> pd.DataFrame:
        # The largest come first, so that what stays fractional tends to be small; among equals the order is a hash's.
        units = units.sort_values(["size", "order", "id", "h"], ascending=[False, True, True, True], kind="stable")
        rng = random.Random(f"{seed}/{last}/{key[0]}/{key[1]}")
        p, size = units["p"].tolist(), units["size"].tolist()
        p = flight(p, size, rng)
        units["p"] = landing(p, size, rng) if last else p
        return units[["id", "h", "src", "size", "p"]]

    return run


def _decide(state: DataFrame, seed: int) -> DataFrame:
    """0 or 1 in place of every ``p``. Only fractional units go through Python, ``BLOCK`` of a source at a time."""
    tasks = int(state.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    decided = state.where("p <= 0 OR p >= 1")
    state, level = written(state.where("p > 0 AND p < 1"), "mix-level"), 0
    while not state.isEmpty():
        counts = written(state.groupBy("src").agg(F.count("*").alias("n")), "mix-counts")  # written, so that its size is known to the join
        last = counts.agg(F.max("n")).first()[0] <= BLOCK
        blocks = counts.select("src", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
        dealt = state.join(blocks, "src").withColumn("order", F.xxhash64("id", "h", F.lit(seed + level)))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("order"), "blocks").cast("int")).drop("blocks")
        dealt = dealt.repartition(tasks, "src", "block")  # stated: what a join has dealt by source alone holds a source in one task
        after = written(dealt.groupBy("src", "block").applyInPandas(_balance(last, seed + level), _UNITS), "mix-level")
        discard(counts)
        discard(state)
        decided = decided.unionByName(after.where("p <= 0 OR p >= 1"))
        state, level = written(after.where("p > 0 AND p < 1"), "mix-level"), level + 1
    discard(state)
    return decided


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """``docs`` with ``size, source_size, target, copies, taken``: how often the mix takes each document.

    A source wanted r times over is taken floor(r) times whole; the fraction that is left is every
    document's inclusion probability, and the cube method turns it into 0 or 1 while it keeps the words and the number of
    documents of the source. Only documents with such a fraction are balanced. Sources are dealt into blocks of about ``BLOCK`` documents
    by hash, so a source with a third of all rows is many tasks; each block leaves at most two fractional documents, which are
    balanced again in the same way until one block per source is left, and only there the landing
    gives up a constraint. The total of a source so misses its target by about half of a small document. Levels go on until nothing is
    fractional; each leaves a thousandth of the units.

    Defined cases: a null text has size 0 and is taken as 0 words; null is a source of its own and comes last; rows
    that repeat id, source and text share one decision. Randomness comes from ``seed`` and hashes, so reruns agree. An
    empty table gives an empty result. The table of sources is joined like any other: broadcast only below Spark's own size limit.
    Columns named like an added one are replaced.
    """
    base = without(docs, *ADDED, *_INNER)
    return _mixed(base, id_col, source_col, text_col, weights, most, seed, set(base.columns) - {id_col}).select(*[F.col(f"`{c}`") for c in base.columns], *ADDED)


_INNER = ("__id", "__h", "__src", "__extra", "__source")


def _mixed(base: DataFrame, id_col: str, source_col: str, text_col: str, weights: tuple[float, ...], most: float, seed: int, whole: set | bool = True) -> DataFrame:
    ident, source = F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string")
    uid = F.coalesce(ident.cast("long"), F.lit(-1))
    h = F.xxhash64(text_of(text_col), F.coalesce(source, F.lit("")), source.isNull(), ident.isNull())
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORDS)), F.lit(0)).cast("long")
    rows = written(base.select(ident.alias("given"), uid.alias("id"), h.alias("h"), source.alias("source"), size.alias("words")), "mix-rows")
    per = source_targets(rows, weights, most)
    units = rows.groupBy("id", "h", "source", "words").agg(F.count("*").alias("m"))
    units = units.join(per.select(F.col("source").alias("s"), "src", "part"), F.col("source").eqNullSafe(F.col("s")))
    state = written(units.select("id", "h", "src", (F.col("words") * F.col("m")).cast("double").alias("size"), F.col("part").alias("p")), "mix-units")
    chosen = _decide(state, seed).select(F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("src").alias("__src"), F.col("p").cast("int").alias("__extra"))
    if whole:
        keyed = base.select("*", uid.alias("__id"), h.alias("__h"), size.alias("size"))
    else:
        keyed = rows.select(F.col("given").alias(id_col), F.col("id").alias("__id"), F.col("h").alias("__h"), F.col("words").alias("size"))
    out = keyed.join(chosen, ["__id", "__h"]).join(per.select(F.col("src").alias("__src"), "source_size", "target", "whole"), "__src")
    return out.withColumn("copies", F.col("whole") + F.col("__extra")).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, seed: int = 7) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as it is taken, with all columns of ``docs`` as they were."""
    out = _mixed(rows_of(docs, id_col, source_col, text_col), id_col, source_col, text_col, weights, most, seed)
    return out.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__row.*")
