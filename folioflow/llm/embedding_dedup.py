"""Near-duplicate embeddings: small-world graphs per shard, every shard queried, beams widened until audits pass."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, small_batches, without, written
from .graph import components
from .hnsw import Graph

#: Vectors that one graph holds (fewer where they are so long that a graph would pass ``SHARD_BYTES``), shards that query a
#: graph in one task, queries searched at a time, queries of an audit.
SHARD, SHARD_BYTES, ROUND, CHUNK, AUDIT = 4096, 64 << 20, 4, 256, 512
ADDED = ("n_links", "component_id", "kept")


def _unit(column: pd.Series) -> np.ndarray:
    x = np.array([np.asarray(v, dtype=np.float64) for v in column])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _pairs(tables) -> np.ndarray:
    return np.concatenate([np.column_stack(np.nonzero(t)) + [a * CHUNK, 0] for a, t in enumerate(tables)])


def exact_hits(vectors: np.ndarray, q: np.ndarray, threshold: float) -> np.ndarray:
    """Row and column of all pairs, by brute force in blocks of queries."""
    return _pairs(q[a : a + CHUNK] @ vectors.T >= threshold - 1e-9 for a in range(0, len(q), CHUNK))


def planted(vectors: np.ndarray, count: int, threshold: float, seed: int = 7) -> np.ndarray:
    """Unit vectors with a cosine between ``threshold`` and 1 to evenly spaced ones of ``vectors``: queries with a true neighbour each."""
    rng = np.random.default_rng(seed)
    at = np.linspace(0, len(vectors) - 1, count).astype(int)
    noise = rng.standard_normal((count, vectors.shape[1]))
    base = vectors[at]
    noise -= (noise * base).sum(axis=1, keepdims=True) * base
    size = np.sqrt((noise * noise).sum(axis=1, keepdims=True))
    cosine = rng.uniform(threshold, 1.0, (count, 1))
    made = cosine * base + np.sqrt(1 - cosine**2) * np.divide(noise, size, out=np.zeros_like(noise), where=size > 0)
    return made / np.sqrt((made * made).sum(axis=1, keepdims=True))


def audit_of(vectors: np.ndarray, q: np.ndarray, threshold: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Queries of an audit and their true neighbours: some of ``q``, evenly spaced, and planted ones.

    There are so many planted ones that a loss of ``1 - recall`` shows however few pairs the data hold.
    """
    some = q[np.unique(np.linspace(0, len(q) - 1, min(AUDIT, len(q))).astype(int))]
    audit = np.concatenate([some, planted(vectors, int(np.ceil(1 / (1 - recall) - 1e-9)) if recall < 1 else len(vectors), threshold)])
    return audit, audit @ vectors.T >= threshold


def audited_hits(graph: Graph, q: np.ndarray, threshold: float, recall: float) -> tuple[np.ndarray, tuple[int, int, int]]:
    """Row and column of all pairs that the graph finds, and how often the beam was widened (-1: answered by brute force), the true
    pairs of the audit, and how many of them were found.

    Audit queries are held against brute force; while they miss more than ``1 - recall`` of their true neighbours, the beam
    doubles and the margin grows by half. Only a graph that still misses some with a beam as wide as the shard is
    given up, and all its queries are answered by brute force.
    """
    beam, margin, widened = 32, 0.02, 0
    audit, truth = audit_of(graph.vectors, q, threshold, recall)
    while True:
        caught = sum(int((graph.within(audit[a : a + CHUNK], threshold, beam, margin) & truth[a : a + CHUNK]).sum()) for a in range(0, len(audit), CHUNK))
        if caught >= recall * truth.sum():
            break
        if beam >= len(graph.vectors):
            return exact_hits(graph.vectors, q, threshold), (-1, int(truth.sum()), caught)
        beam, margin, widened = beam * 2, margin * 1.5, widened + 1
    return _pairs(graph.within(q[a : a + CHUNK], threshold, beam, margin) for a in range(0, len(q), CHUNK)), (widened, int(truth.sum()), caught)


def _sorted(part: pd.DataFrame) -> pd.DataFrame:
    return part.sort_values(["shard", "cid"], kind="stable").reset_index(drop=True)


def _slim(x: np.ndarray) -> np.ndarray:
    """The same numbers in half the bytes where they are all single ones."""
    small = x.astype(np.float32)
    return small if (small == x).all() else x


def _build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
    """A shard's graph, once: its vectors, ids and copies with it. Unit vectors are left out and made again."""
    part = _sorted(part)
    raw = np.stack(part["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)).tolist())
    graph = Graph(_unit(part["embedding"]))
    graph.vectors = None
    blob = pickle.dumps((graph, _slim(raw), part["cid"].to_numpy(), part["copies"].to_numpy()), protocol=5)
    return pd.DataFrame({"label": [key[0]], "dim": [key[1]], "shard": [key[2]], "shards": [part["shards"][0]], "graph": [blob]})


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    parts = [slice(k, k + 65536) for k in range(0, len(a), 65536)]
    found = [(a[s] * b[s]).sum(axis=1) / np.sqrt((a[s] ** 2).sum(axis=1) * (b[s] ** 2).sum(axis=1)) for s in parts]
    return np.concatenate(found) if found else np.empty(0)


def _links(threshold: float, recall: float):
    """Link counts and a forest over what one graph and the shards that query it hold, and a row (cid -1 - shard) for each audit."""

    def run(key: tuple, queries: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        graph, raw, cid, copies = pickle.loads(bytes(graphs["graph"][0]))
        raw = raw.astype(np.float64)
        shard, ids, sizes, x_all, y_all, audits = int(key[2]), [cid], [copies], [], [], []
        unit = raw / np.abs(raw).max(axis=1, keepdims=True)
        unit = unit / np.sqrt((unit * unit).sum(axis=1, keepdims=True))
        graph.vectors, at = unit, len(cid)
        for other, mine in _sorted(queries).groupby("shard", sort=True):
            same, q = other == shard, _unit(mine["embedding"])
            hits, (widened, true, caught) = audited_hits(graph, q, threshold, recall)
            if same:
                hits = np.unique(np.sort(hits[hits[:, 0] != hits[:, 1]], axis=1), axis=0)
            a = np.stack(mine["embedding"].map(lambda v: np.asarray(v, dtype=np.float64)).tolist())
            good = _cosines(a[hits[:, 0]], raw[hits[:, 1]]) >= threshold
            x, y = hits[good, 0], hits[good, 1]
            audits.append((-1 - int(other), widened, len(x), true, caught))
            if not same:
                ids.append(mine["cid"].to_numpy())
                sizes.append(mine["copies"].to_numpy())
                x, at = x + at, at + len(mine)
            x_all.append(x)
            y_all.append(y)
        ids, size = np.concatenate(ids), np.concatenate(sizes)
        x, y = np.concatenate(x_all), np.concatenate(y_all)
        links = np.zeros(len(ids), dtype=np.int64)
        np.add.at(links, x, size[y])
        np.add.at(links, y, size[x])
        root = list(range(len(ids)))

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            ru, rv = find(u), find(v)
            root[max(ru, rv)] = min(ru, rv)
        has = np.flatnonzero(links)
        found = pd.DataFrame({"cid": ids[has], "links": links[has], "root": ids[[find(c) for c in has]] if len(has) else ids[:0], "true": 0, "caught": 0})
        return pd.concat([found, pd.DataFrame(audits, columns=found.columns)], ignore_index=True).astype("int64")

    return run


def embedding_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, recall: float = 0.999, shard: int = SHARD) -> DataFrame:
    """``vectors`` with ``n_links, component_id, kept``: links are pairs of one label with cosine >= ``threshold``.

    Equal vectors of a label are one class from the start (linked to each other, counted by size), so a
    vector that a third of all rows share is one row. Classes of a label are dealt by hash into shards of about ``shard``;
    a label with a third of all rows is many shards. Each shard's graph is built once and stored; every other shard of the label
    queries it, ``ROUND`` of them a task. A task audits the recall of each shard's queries against brute force, widens until the audit
    passes (planted queries give every audit true pairs; a graph that fails at its widest beam is replaced by brute force in blocks) and verifies each hit in double precision. It
    returns link counts and one forest edge a vector, never its pairs; components are unioned over those.

    A class goes by a number of its own, never by an id; a component takes the smallest id of its classes, and rows get their result by
    label and a 128-bit digest of the vector. Defined cases: rows whose label or vector is null, or whose vector is empty, zero or holds null or
    non-finite components, link with nothing, keep ``n_links`` 0 and are their own component. Vectors of different lengths
    are never linked. Null ids link like others but are a component's id only if all its ids are null. Rows
    that repeat id and vector count as further vectors; an id under several labels goes by each label's own vectors.
    Columns named like an added one are replaced; an empty table gives an empty result.
    """
    base = without(vectors, *ADDED, "__l", "__v", "__d")
    ident = F.col(f"`{id_col}`").cast("long")
    v = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col(label_col).isNotNull() & v.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    keyed = base.withColumn("__l", F.when(usable, F.col(label_col).cast("string"))).withColumn("__v", F.when(usable, v))
    keyed = keyed.withColumn("__d", F.md5(F.concat_ws(",", F.col("__v").cast("array<string>"))))
    classes, found = _found(keyed.where("__l IS NOT NULL").select("__l", "__d", "__v", ident.alias("id")), threshold, recall, shard)
    links = found.where("cid >= 0")
    linked = written(components(links.select(F.col("cid").alias("u"), F.col("root").alias("v"))), "vec-linked")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    placed = classes.drop("__v").join(counts, "cid", "left").join(linked.withColumnRenamed("id", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    placed = written(placed.select("__l", "__d", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component", "first"), "vec-placed")
    named = placed.groupBy("component").agg(F.min("first").alias("first"))
    known = written(placed.drop("first").join(named, "component").select("__l", "__d", "n_links", F.col("first.id").alias("component_id")), "vec-known")
    discard(classes, found, linked, placed)
    names = [F.col(f"`{c}`") for c in base.columns]
    out = keyed.where("__l IS NOT NULL").join(known, ["__l", "__d"]).select(*names, "n_links", "component_id")
    alone = keyed.where("__l IS NULL").select(*names, F.lit(0).cast("long").alias("n_links"), ident.alias("component_id"))
    return out.unionByName(alone).withColumn("kept", ident.eqNullSafe(F.col("component_id")))


def _found(keyed: DataFrame, threshold: float, recall: float, shard: int) -> tuple[DataFrame, DataFrame]:
    """The classes of equal vectors, and what the tasks found among them.

    A row of ``cid`` -1 - s tells of the audit of shard s at a graph: ``links`` how often the beam was widened (-1: brute force), ``root``
    the pairs linked, ``true`` and ``caught`` the audit's true pairs and those found.
    """
    spark = keyed.sparkSession
    small_batches(spark)
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id"))
    grouped = keyed.groupBy("__l", "__d").agg(F.first("__v").alias("__v"), least.alias("first"), F.count("*").alias("copies"))
    classes = written(grouped.withColumn("dim", F.size("__v")).withColumn("cid", F.monotonically_increasing_id()), "vec-classes")
    most = F.greatest(F.lit(1), F.least(F.lit(shard), F.floor(F.lit(SHARD_BYTES) / (8 * F.col("dim")))))
    per = classes.groupBy("__l", "dim").agg(F.count("*").alias("n")).select("__l", "dim", F.ceil(F.col("n") / most).cast("int").alias("shards"))
    dealt = classes.join(per, ["__l", "dim"]).select("__l", "dim", "shards", F.pmod(F.xxhash64("cid"), "shards").cast("int").alias("shard"), "cid", "copies", F.col("__v").alias("embedding"))
    dealt = written(dealt, "vec-dealt")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # stated, so that few bytes with much work are not folded together
    built = dealt.withColumnRenamed("__l", "label").repartition(n, "label", "dim", "shard").groupBy("label", "dim", "shard")
    graphs = written(built.applyInPandas(_build, "label string, dim int, shard int, shards int, graph binary"), "vec-graphs")
    # Shard i queries the graphs of the shards from i on, in rounds counted from each graph's own shard.
    asked = dealt.withColumn("at", F.explode(F.sequence("shard", F.col("shards") - 1))).withColumn("turn", F.floor((F.col("at") - F.col("shard")) / ROUND).cast("int"))
    asked = asked.select(F.col("__l").alias("label"), "dim", "at", "turn", "shard", "cid", "copies", "embedding")
    turns = F.explode(F.sequence(F.lit(0), F.floor(F.col("shard") / ROUND).cast("int")))
    served = graphs.select("label", "dim", F.col("shard").alias("at"), turns.alias("turn"), "graph")
    keys = ("label", "dim", "at", "turn")
    pairs = asked.repartition(n, *keys).groupBy(*keys).cogroup(served.repartition(n, *keys).groupBy(*keys))
    found = written(pairs.applyInPandas(_links(threshold, recall), "cid long, links long, root long, true long, caught long"), "vec-links")
    discard(dealt, graphs)
    return classes, found
