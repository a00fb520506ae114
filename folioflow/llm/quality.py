"""Quality by co-training: a text-content view and a page-metadata view teach each other."""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, held_out, rows_of, small_batches, text_of, with_scores, without, written

WORDS, SIZES, SOURCES, LANGS = 512, 24, 64, 16
ADDED = ("held_out", "text_score", "meta_score", "score", "predicted", "kept_quality")


class _Slots(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = slot = xxhash.xxh32_intdigest(word.encode()) % WORDS
        return slot


_SLOTS = _Slots()


def text_view(text: str) -> np.ndarray:
    """Content of the whole text: letter-case, punctuation and repetition shares, and hashed word frequencies."""
    words = text.lower().split()
    n, chars = max(1, len(words)), max(1, len(text))
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    by = np.bincount(raw, minlength=256) / max(1, len(raw))
    slots = np.fromiter(map(_SLOTS.__getitem__, words), dtype=np.int64, count=len(words))
    again = float((slots[1:] == slots[:-1]).mean()) if len(slots) > 1 else 0.0
    head = [np.log1p(len(words)), len(set(words)) / n, again, by[65:91].sum(), by[97:123].sum(), by[48:58].sum(), by[33], by[124], by[46], by[44], by[128:].sum(), chars / n / 10, by[60] + by[62] + by[123] + by[125]]
    return np.concatenate([np.array(head), np.bincount(slots, minlength=WORDS) / n])


def meta_view(n_chars: float | None, lang: str | None, source: str | None) -> np.ndarray:
    """What a crawler records of a page, and nothing of its text: length, language and source."""
    out = np.zeros(2 + SIZES + LANGS + SOURCES)
    if n_chars is None or n_chars != n_chars:
        out[1] = 1
    else:
        out[0] = np.log1p(max(0.0, float(n_chars))) / 10
        out[2 + min(SIZES - 1, int(np.log2(1 + max(0.0, float(n_chars)))))] = 1
    out[2 + SIZES + xxhash.xxh32_intdigest(str(lang).encode()) % LANGS] = 1
    out[2 + SIZES + LANGS + xxhash.xxh32_intdigest(str(source).encode()) % SOURCES] = 1
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 3.0, steps: int = 25) -> Logistic:
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        found = cls(mean, scale, np.zeros(x.shape[1] + 1))
        for _ in range(steps):
            if np.abs(found.step(found.gradient(x, y, weight), found.curvature(x, weight), ridge)).max() < 1e-5:
                break
        return found

    def rows(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.clip((x - self.mean) / self.scale, -8, 8), np.ones(len(x))])

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Gradient of the loss at these rows; it adds up over any parts of the data."""
        z = self.rows(x)
        return z.T @ (weight * (1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30))) - y))

    def curvature(self, x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        z = self.rows(x)
        p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
        return (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z

    def step(self, grad: np.ndarray, curve: np.ndarray, ridge: float = 3.0) -> np.ndarray:
        """One damped Newton step."""
        reg = np.full(len(self.w), ridge)
        reg[-1] = 1e-3
        by = np.linalg.solve(curve + np.diag(reg), grad + reg * self.w)
        self.w = self.w - by * min(1.0, 5.0 / (np.abs(by).max() + 1e-9))
        return by

    def margin(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.w[:-1] + self.w[-1]


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    mix: Logistic
    calibration: tuple[Logistic, Logistic]

    def scores(self, xt: np.ndarray, xm: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mt, mm = self.text.margin(xt), self.meta.margin(xm)
        views = [1 / (1 + np.exp(-np.clip(c.margin(m[:, None]), -30, 30))) for c, m in zip(self.calibration, (mt, mm), strict=True)]
        return views[0], views[1], 1 / (1 + np.exp(-np.clip(self.mix.margin(np.column_stack([mt, mm])), -30, 30)))


def sure_margin(margin: np.ndarray, y: np.ndarray, label: int, sure: float, least: int = 5) -> float:
    """The smallest margin from which a view is right about ``label`` on at least ``sure`` of (and ``least``) calibration rows; inf if none."""
    toward = margin if label else -margin
    order = np.argsort(-toward, kind="stable")
    right = np.cumsum(y[order] == label) / np.arange(1, len(order) + 1)
    good = np.flatnonzero((right >= sure) & (np.arange(1, len(order) + 1) >= least) & (toward[order] > 0))
    return float(toward[order][good[-1]]) if len(good) else float("inf")


#: What a pass over the pool brings for each view: rows and gradient for either lent label, and the curvature over both.
Sums = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def lent_sums(views: tuple[Logistic, Logistic], least: list[list[float]], x: tuple[np.ndarray, np.ndarray]) -> Sums:
    """For either view, the sums over the rows of which the other view is sure."""
    margins, out = [v.margin(a) for v, a in zip(views, x, strict=True)], []
    for k, view in enumerate(views):
        sure = [(margins[1 - k] if label else -margins[1 - k]) >= least[1 - k][label] for label in (0, 1)]
        grads = [view.gradient(x[k][r], np.full(int(r.sum()), float(label)), np.ones(int(r.sum()))) for label, r in enumerate(sure)]
        rows = x[k][sure[0] | sure[1]]
        out.append((np.array([float(r.sum()) for r in sure]), np.array(grads), view.curvature(rows, np.ones(len(rows))).astype(np.float32)))
    return out


def add_sums(a: Sums | None, b: Sums) -> Sums:
    return b if a is None else [tuple(p + q for p, q in zip(v, w, strict=True)) for v, w in zip(a, b, strict=True)]


def co_train(xt: np.ndarray, xm: np.ndarray, y: np.ndarray, lent, rounds: int = 4, sure: float = 0.95, share: float = 0.5) -> CoTrained | None:
    """Both views' classifiers from labelled rows and a pool of any size. Every fourth labelled row calibrates and is not trained on.

    Each view starts from the labelled rows. In each round it lends its label to all pool rows whose margin is one at which it was right on
    at least ``sure`` of the calibration rows, and the other view takes a Newton step on its labelled rows and on what is lent to it;
    the lent rows of a class together weigh ``share`` of its labelled ones, so a larger pool makes them steadier, not heavier.
    ``lent(views, margins)`` passes once over the pool and returns ``lent_sums`` of it, or None where the pool is empty.
    """
    calibrate = np.arange(len(y)) % 4 == 0
    own, goal = y[~calibrate], y[calibrate].astype(float)
    if len(set(own.tolist())) < 2 or len(set(goal.tolist())) < 2:
        return None
    x = (xt, xm)
    fitted = tuple(Logistic.fit(a[~calibrate], own, np.ones(len(own))) for a in x)
    for _ in range(rounds):
        least = [[sure_margin(v.margin(a[calibrate]), y[calibrate], label, sure) for label in (0, 1)] for v, a in zip(fitted, x, strict=True)]
        sums = lent(fitted, least)
        if sums is None:
            break
        for v, a, per in zip(fitted, x, sums, strict=True):
            n, grads, curve = per
            weight = np.array([share * (own == label).sum() / c if c else 0.0 for label, c in enumerate(n)])
            ones, mean = np.ones(len(own)), float(weight @ n / max(1.0, n.sum()))
            v.step(v.gradient(a[~calibrate], own, ones) + weight @ grads, v.curvature(a[~calibrate], ones) + mean * curve)
    ones = np.ones(len(goal))
    margins = [v.margin(a[calibrate]) for v, a in zip(fitted, x, strict=True)]
    single = tuple(Logistic.fit(m[:, None], goal, ones, 1.0) for m in margins)
    return CoTrained(fitted[0], fitted[1], Logistic.fit(np.column_stack(margins), goal, ones, 1.0), single)


def _rows(docs: DataFrame, text_col: str):
    have = {c.lower() for c in docs.columns}
    text = text_of(text_col)
    column = lambda name, kind: (F.col(f"`{name}`") if name in have else F.lit(None)).cast(kind).alias(name)
    return [text.alias("text"), column("n_chars", "double"), column("lang", "string"), column("source", "string")]


def _views(batch: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    xm = [meta_view(None if pd.isna(n) else n, lang, source) for n, lang, source in zip(batch["n_chars"], batch["lang"], batch["source"], strict=True)]
    return np.array([text_view(t) for t in batch["text"]]), np.array(xm)


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            xt, xm = _views(b)
            yield pd.DataFrame({"id": b["id"], "xt": [x.astype("<f2").tobytes() for x in xt], "xm": [x.astype("<f2").tobytes() for x in xm]})


def _stacked(column) -> np.ndarray:
    return np.frombuffer(b"".join(map(bytes, column)), dtype="<f2").reshape(len(column), -1).astype(np.float64)


def _pool_pass(pool: DataFrame):
    """``lent`` over a table of views: a task adds up its rows, then few tasks add up many, each one row at a time."""
    spark = pool.sparkSession

    def lent(views: tuple[Logistic, Logistic], least: list[list[float]]) -> Sums | None:
        shared = spark.sparkContext.broadcast((views, least))

        def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                if len(b):
                    total = add_sums(total, lent_sums(*shared.value, (_stacked(b["xt"]), _stacked(b["xm"]))))
            if total is not None:
                yield pd.DataFrame({"sums": [pickle.dumps(total)]})

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = None
            for b in batches:
                for raw in b["sums"]:
                    total = add_sums(total, pickle.loads(bytes(raw)))
            if total is not None:
                yield pd.DataFrame({"sums": [pickle.dumps(total)]})

        # About a megabyte a task, so that few are added up at a time.
        done = written(pool.select("xt", "xm").mapInPandas(part, "sums binary"), "quality-sums")
        while (n := done.count()) > 8:
            fewer = written(done.repartition(-(-n // 16)).mapInPandas(add, "sums binary"), "quality-sums")
            discard(done)
            done = fewer
        total = None
        for r in done.toLocalIterator():
            total = add_sums(total, pickle.loads(bytes(r["sums"])))
        discard(done)
        return total

    return lent


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", labelled: int = 4000) -> CoTrained | None:
    """Co-train on at most ``labelled`` labelled documents (the smallest hashes of their ids) and on all that have no label, held-out ids apart.

    An id with several labels counts as the rounded mean, half up; null ids neither teach nor join the pool. None when the sample lacks a class.
    Both views of every document are written once, as half-precision numbers (a tenth to a third of the texts); each round reads that table.
    """
    small_batches(docs.sparkSession)
    y = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    y = y.agg((F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y"))
    ident = F.col(f"`{id_col}`").cast("long")
    slim = docs.select(ident.alias("id"), *_rows(docs, text_col)).where(F.col("id").isNotNull() & ~held_out(F.col("id")))
    views = written(slim.mapInPandas(_extract, "id long, xt binary, xm binary"), "quality-views")
    order = F.xxhash64("id", F.lit(9))
    picked = y.where(~held_out(F.col("id"))).join(views.select("id"), "id", "left_semi").withColumn("o", order).orderBy("o", "id").limit(labelled)
    want = F.broadcast(docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in picked.collect()], "id long, y int"))
    one = views.join(want, "id").groupBy("id").agg(F.min(F.struct("xt", "xm", "y")).alias("r")).orderBy("id")  # a row an id, however often it occurs
    found = [(r["id"], r["r"]["y"], r["r"]["xt"], r["r"]["xm"]) for r in one.toLocalIterator()]
    pool = written(views.join(y, "id", "left_anti"), "quality-pool")
    discard(views)
    if not found:
        return None
    model = co_train(_stacked([r[2] for r in found]), _stacked([r[3] for r in found]), np.array([r[1] for r in found]), _pool_pass(pool))
    discard(pool)
    return model


def score_quality(docs: DataFrame, model: CoTrained | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out, text_score, meta_score, score, predicted``; documents under 0.5 are to be rejected.

    Defined cases: null and empty texts are scored as texts without words; a missing or null metadata column is a value of its own; null
    ids pass through; repeated rows score alike; without a model (no labels of both classes) every score is 1; columns named like an added one are replaced.
    """
    base = without(docs, *ADDED)
    return _scored(base, base.columns, model, text_col).withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _scored(docs: DataFrame, carry: list[str], model: CoTrained | None, text_col: str) -> DataFrame:
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batch: pd.DataFrame) -> list[np.ndarray]:
        m = shared.value
        return list(m.scores(*_views(batch))) if m is not None else [np.ones(len(batch))] * 3

    return with_scores(docs, carry, _rows(docs, text_col), score, ["text_score", "meta_score", "score"])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` with a score of 0.5 or more, with all columns of ``docs`` as they were."""
    named = [c for c in ("n_chars", "lang", "source") if c in docs.columns]
    model = fit_quality(docs, labels, id_col, text_col, **options)
    return _scored(rows_of(docs, text_col, *named), ["__row"], model, text_col).where("score >= 0.5").select("__row.*")
