"""Near-duplicate documents by HyperMinHash bands, estimates on compressed registers and verification on whole sets."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, one_of_each, rows_of, small_batches, text_of, without, written
from .graph import components
from .hyperminhash import REGISTERS, band_keys, estimate, few_keys, jaccard_counts, possible, registers, rows_for, set_key, shingles

#: Members of a block, two of which meet in one task, and steps of set size that make up the threshold.
BLOCK, STEPS = 512, 4
ADDED = ("n_shingles", "component_id", "kept")


def _registers(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype=np.uint16).reshape(-1, REGISTERS)


def _signatures(width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sets = [shingles(t, width) for t in b["text"]]
            keys = [set_key(s) for s in sets]
            yield pd.DataFrame(
                {
                    "id": b["id"], "t": b["t"], "n": [len(s) for s in sets], "k1": [k[0] for k in keys], "k2": [k[1] for k in keys],
                    "regs": [registers(s).tobytes() for s in sets],
                }
            )

    return run


def _bands(rows: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            regs, cid = _registers(b["regs"]), b["cid"].to_numpy()
            (keys, used), (few, more) = band_keys(regs, rows), few_keys(regs)
            yield pd.DataFrame({"band": np.concatenate([keys[used], more]), "cid": np.concatenate([np.repeat(cid, used.sum(axis=1)), cid[few]])})

    return run


def _likely(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield b.loc[possible(*estimate(_registers(b["regs"]), _registers(b["hub_regs"])), threshold), ["hub", "cid"]]

    return run


def _verified(percent: int, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        set_of = lru_cache(8)(lambda t: shingles(t, width))
        for b in batches:
            counts = [jaccard_counts(set_of(h), shingles(t, width)) for h, t in zip(b["hub_text"], b["text"], strict=True)]
            yield b.loc[np.array([100 * i >= percent * u for i, u in counts], dtype=bool), ["hub", "cid"]]

    return run


def _open_pairs(hub: int, i: int, j: int, regs: np.ndarray, comp: np.ndarray, block: np.ndarray, ids: np.ndarray, threshold: float) -> np.ndarray:
    """Index pairs of a task's members that sit in different components and may reach the threshold; pairs with the hub are known."""
    left, right = np.flatnonzero((block == i) & (ids != hub)), np.flatnonzero((block == j) & (ids != hub))
    found = []
    for x in left:
        y = right[(comp[right] != comp[x]) & ((ids[right] > ids[x]) if i == j else True)]
        if len(y):
            y = y[possible(*estimate(regs[x][None], regs[y]), threshold)]
            found.append(np.column_stack([np.full(len(y), x), y]))
    return np.concatenate(found) if found else np.empty((0, 2), dtype=int)


def _doubtful(threshold: float):
    """Over rows sorted by task, a batch holding many small tasks: the members that have a possible partner."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in chain(batches, [None]):
            last = b is None
            b = rest if last else b if rest is None else pd.concat([rest, b], ignore_index=True)
            if b is None or not len(b):
                continue
            key = b[["hub", "i", "j"]].to_numpy()
            first = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1, [len(b)]])
            if not last:
                rest, first = b.iloc[first[-2] :], first[:-1]
            regs, comp, block, ids = _registers(b["regs"]), b["comp"].to_numpy(), b["blk"].to_numpy(), b["cid"].to_numpy()
            kept = []
            for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                if (comp[s:e] != comp[s]).any():
                    kept.append(s + np.unique(_open_pairs(*key[s].tolist(), regs[s:e], comp[s:e], block[s:e], ids[s:e], threshold)))
            if kept:
                yield b.iloc[np.concatenate(kept)][["hub", "i", "j", "cid", "comp", "blk", "regs"]]

    return run


def _forest(threshold: float, percent: int, width: int):
    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates(["cid", "text"]).reset_index(drop=True)
        columns = (part[c].to_numpy() for c in ("comp", "blk", "cid"))
        pairs = _open_pairs(*map(int, key), _registers(part["regs"]), *columns, threshold)
        sets = [shingles(t, width) for t in part["text"]]
        comp, ids, root, out = part["comp"].tolist(), part["cid"].tolist(), {}, []

        def find(c: int) -> int:
            while root.get(c, c) != c:
                root[c] = root.get(root[c], root[c])
                c = root[c]
            return c

        for a, b in pairs.tolist():
            ra, rb = find(comp[a]), find(comp[b])
            if ra != rb:
                both, union = jaccard_counts(sets[a], sets[b])
                if 100 * both >= percent * union:
                    root[ra] = rb
                    out.append((ids[a], ids[b]))
        return pd.DataFrame(out, columns=["hub", "cid"], dtype="int64")

    return run


def _blocks(steps: list[tuple[int, int, int]]) -> list[tuple[int, bool, int, int, list[int]]]:
    """How the members of one hub are cut into blocks: (step, apart, first block, blocks, blocks that these meet) for each size step.

    ``steps`` are (step, members apart from the hub's component, other members) in order of size. Neighbouring steps share a block up to ``BLOCK``
    members, a fuller step has several. Blocks meet where one of them holds members apart and their sizes allow a link.
    """
    made, where = [], {}  # (apart, lowest step, highest step); (step, apart) -> (first block, blocks)
    for apart in (True, False):
        room = 0
        for step, a, m in steps:
            n = a if apart else m
            if not n:
                continue
            if n <= room:
                made[-1] = (apart, made[-1][1], step)
                where[step, apart], room = (len(made) - 1, 1), room - n
            else:
                several = -(-n // BLOCK)
                where[step, apart] = (len(made), several)
                made += [(apart, step, step)] * several
                room = BLOCK - n if several == 1 else 0
    near = lambda p, q: (p[0] or q[0]) and p[1] - q[2] <= STEPS and q[1] - p[2] <= STEPS
    meets = {p: [j for j, q in enumerate(made) if near(p, q)] for p in set(made)}
    return [(step, apart, first, n, meets[made[first]]) for (step, apart), (first, n) in where.items()]


def _planned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(hub, *r) for hub, steps in zip(b["hub"], b["steps"], strict=True) for r in _blocks([(s["step"], s["a"], s["m"]) for s in steps])]
        yield pd.DataFrame(rows, columns=["hub", "step", "apart", "first", "blocks", "meets"])


def _meetings(sides: DataFrame, percent: int) -> DataFrame:
    """``sides`` (hub, cid, comp, apart, n) with ``blk`` and one row for each task (``i``, ``j``) that the member is in.

    Sets are counted by hub and by size on a geometric scale, ``STEPS`` steps of which are the threshold; a hub has some hundred steps at
    most, whatever its group's size, and blocks are planned on these counts. Within a step members go to blocks by hash.
    """
    step = F.floor(F.log("n") * STEPS / (math.log(100 / min(percent, 99)) * (1 + 1e-9))).cast("int")
    sides = sides.withColumn("step", step)
    per = sides.groupBy("hub", "step").agg(F.count_if("apart").alias("a"), F.count_if(~F.col("apart")).alias("m"))
    hubs = per.groupBy("hub").agg(F.array_sort(F.collect_list(F.struct("step", "a", "m"))).alias("steps"), F.sum("a").alias("open"), F.sum(F.col("a") + F.col("m")).alias("all"))
    schema = "hub long, step int, apart boolean, first long, blocks int, meets array<long>"
    plan = written(hubs.where("open > 0 AND `all` > 1").select("hub", "steps").mapInPandas(_planned, schema), "near-plan")
    dealt = sides.join(plan, ["hub", "step", "apart"]).withColumn("blk", F.col("first") + F.pmod(F.xxhash64("cid"), F.col("blocks")))
    dealt = dealt.select("hub", "cid", "comp", "blk", F.explode("meets").alias("o"))
    return dealt.withColumn("i", F.least("blk", "o")).withColumn("j", F.greatest("blk", "o"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = 5) -> DataFrame:
    """``docs`` with ``n_shingles, component_id, kept``: documents linked at Jaccard >= ``percent`` / 100.

    1. One pass over whole texts gives each document its set's size, a 128-bit key and its HyperMinHash registers.
       Documents with the same set are one class, so a group of copies is one row from here on.
    2. Bands of registers make the candidates, as long as a pair at the threshold shares none with a chance below 1e-8 (50
       bands of 5 at 0.80, 42 of 6 at 0.85). Sets of five shingles and less, for which one band may hold all that is shared, also meet in
       keys that leave one out.
    3. In each band's bucket the most central member (the one whose buckets are largest) is the hub and every
       member is paired with it: rows, not squares. Pairs pass a size test and the collision-corrected
       estimate (six deviations of slack), and are then verified on the sets of their whole texts.
    4. Members of a hub's group (the hub itself is done) that are not in the hub's component meet, in blocks of ``BLOCK`` inside tasks, each
       other and the members that are, where set sizes allow a link: first by registers, then those with a possible partner by their whole sets.
       Only links that join components leave a task. This finds what the hubs did not, with no cap or sample; its work is the
       group's size times its unconnected members of like size, so quadratic only in texts that look alike and yet are not linked.
    5. Links are unioned by large-star and small-star rounds.

    Hashes of shingles have 64 bits, class keys and text digests 128, so equality on sets errs with a chance far below 1e-9 a table.
    Up to the end a class goes by a number of its own, never by an id; a component then takes the smallest id of its classes, and
    rows get their result by their text's digest. Defined cases: no words (or null) is an empty set, linked with nothing; null ids link like
    others but are never a component's id unless all its ids are null; rows that repeat an id go by their own text, any
    long is an id. ``kept`` is id = component id, so true for each row of a component's id (``keep_one_of_each`` keeps one).
    Columns of ``docs`` named like an added one are replaced; an empty table gives an empty result.
    """
    marks, sig = _marks(docs, id_col, text_col, percent, width)
    ident = F.col(f"`{id_col}`").cast("long")
    if set(docs.columns) - {id_col, text_col}:
        base = without(docs, *ADDED, "__t")
        names = base.columns
        found = base.withColumn("__t", F.md5(text_of(text_col).cast("binary"))).join(marks.withColumnRenamed("t", "__t"), "__t")
    else:
        names = [id_col]
        found = sig.select(F.col("id").alias(id_col), "t").join(marks, "t")
    found = found.withColumn("__component", F.when(F.col("__n") == 0, ident).otherwise(F.col("__component")))
    return found.select(
        *[F.col(f"`{c}`") for c in names], F.col("__n").alias("n_shingles"), F.col("__component").alias("component_id"),
        ident.eqNullSafe(F.col("__component")).alias("kept"),
    )


def _marks(docs: DataFrame, id_col: str, text_col: str, percent: int, width: int) -> tuple[DataFrame, DataFrame]:
    """Per distinct text ``t, __n, __component, __first`` (the text and id that stand for its component); and the signatures' ids."""
    spark, threshold = docs.sparkSession, percent / 100
    small_batches(spark)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.md5(text_of(text_col).cast("binary")).alias("t"), text_of(text_col).alias("text"))
    # Ids go through Python as text: a null would turn a column of longs into floats.
    signed = rows.withColumn("id", F.col("id").cast("string")).mapInPandas(_signatures(width), "id string, t string, n long, k1 long, k2 long, regs binary")
    sig = written(signed.withColumn("id", F.col("id").cast("long")), "near-signatures")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "t"))
    grouped = sig.where("n > 0").groupBy("k1", "k2", "n", "regs").agg(least.alias("first"))
    classes = written(grouped.select("k1", "k2", "n", "regs", "first", F.monotonically_increasing_id().alias("cid")), "near-classes")
    slim = written(sig.drop("regs"), "near-ids")
    discard(sig)
    bands = written(classes.select("cid", "regs").mapInPandas(_bands(rows_for(threshold)), "band long, cid long"), "near-bands")
    counts = written(bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1"), "near-counts")
    shared = written(bands.join(counts, "band"), "near-shared")
    discard(bands, counts)
    central = written(shared.groupBy("cid").agg(F.sum("c").alias("w")), "near-central")
    ranked = shared.select("band", "cid").join(central, "cid")
    best = F.max(F.struct("w", (-F.col("cid")).alias("less"))).alias("best")
    hubs = written(ranked.groupBy("band").agg(best).select("band", (-F.col("best.less")).alias("hub")), "near-hubs")
    star = written(shared.select("band", "cid").join(hubs, "band").where("hub <> cid").select("hub", "cid").distinct(), "near-stars")
    discard(shared, hubs)

    regs = classes.select("cid", "n", "regs")
    hub_regs = classes.select(F.col("cid").alias("hub"), F.col("n").alias("hub_n"), F.col("regs").alias("hub_regs"))
    sized = star.join(regs, "cid").join(hub_regs, "hub").where(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    likely = written(sized.select("hub", "cid", "regs", "hub_regs").mapInPandas(_likely(threshold), "hub long, cid long"), "near-likely")
    stands = classes.join(central.select("cid"), "cid", "left_semi").select(F.col("first.t").alias("t"), "cid")
    texts = written(rows.select("t", "text").dropDuplicates(["t"]).join(stands, "t").select("cid", "text"), "near-texts")
    discard(central)
    theirs = texts.toDF("hub", "hub_text")
    pairs = likely.join(texts, "cid").join(theirs, "hub").select("hub", "cid", "hub_text", "text")
    links = written(pairs.mapInPandas(_verified(percent, width), "hub long, cid long"), "near-links")
    discard(likely)
    linked = written(components(links.toDF("u", "v")), "near-linked")

    comps = lambda name, comp: linked.toDF(name, comp)
    sides = star.join(comps("cid", "comp"), "cid", "left").join(comps("hub", "hub_comp"), "hub", "left").join(classes.select("cid", "n"), "cid")
    comp = F.coalesce("comp", "cid")
    sides = written(sides.select("hub", "cid", "n", comp.alias("comp"), (comp != F.coalesce("hub_comp", "hub")).alias("apart")), "near-members")
    discard(star)
    fields = "hub long, i long, j long, cid long, comp long, blk long, regs binary"
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = _meetings(sides, percent).join(regs.drop("n"), "cid").select(*[f.split()[0] for f in fields.split(", ")])
    dealt = dealt.repartition(tasks, "hub", "i", "j").sortWithinPartitions("hub", "i", "j")
    doubtful = written(dealt.mapInPandas(_doubtful(threshold), fields), "near-doubtful")
    discard(sides)
    forest = doubtful.join(texts, "cid").repartition(tasks, "hub", "i", "j").groupBy("hub", "i", "j").applyInPandas(_forest(threshold, percent, width), "hub long, cid long")
    more = written(forest, "near-more")
    discard(doubtful, texts)
    if not more.isEmpty():
        discard(linked)
        linked = written(components(links.unionByName(more).toDF("u", "v")), "near-linked")
    discard(links, more)

    placed = written(classes.select("cid", "first", "k1", "k2").join(comps("cid", "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid")), "near-placed")
    discard(classes, linked)
    named = placed.groupBy("comp").agg(F.min("first").alias("__first"))
    by_class = placed.select("k1", "k2", "comp").join(named, "comp").select("k1", "k2", "__first")
    kinds = slim.select("t", "n", "k1", "k2").distinct().join(by_class, ["k1", "k2"], "left")
    marks = written(kinds.select("t", F.col("n").alias("__n"), F.col("__first.id").alias("__component"), "__first"), "near-marks")
    discard(placed)
    return marks, slim


def keep_one_of_each(docs: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of ``docs`` that stand for their component, one each, with all columns of ``docs`` as they were.

    The smallest id stands for its component; of its texts, should it have several there, the one of the smallest digest; of
    full repeats of that row any. Null ids stand only where there is no other. Rows without words stay, all of them.
    """
    slim = rows_of(docs, id_col, text_col)
    marks, ids = _marks(slim, id_col, text_col, percent, width)
    stands = marks.where("__n > 0 AND t = __first.t")
    same = ids.join(stands.select("t", F.col("__component").alias("c")), "t").where("id <=> c").groupBy("t").agg((F.count("*") > 1).alias("__tied"))
    same = written(same, "near-stands")
    keyed = slim.select("__row", F.col(f"`{id_col}`").cast("long").alias("__id"), F.md5(text_of(text_col).cast("binary")).alias("t"))
    chosen = marks.join(same, "t", "left").where("__n = 0 OR __tied IS NOT NULL").select("t", "__n", "__component", F.coalesce("__tied", F.lit(False)).alias("__tied"))
    rows = keyed.join(chosen, "t").where("__n = 0 OR __id <=> __component")
    if same.where("__tied").isEmpty():
        return rows.select("__row.*")
    return one_of_each(rows, "t", "__tied")
