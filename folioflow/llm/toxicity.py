"""Toxicity by a subsequence-kernel support vector machine with Nystroem landmarks, trained on labelled sentences."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ssk
from ._common import held_out, small_batches, text_of, with_scores, without

#: A run of marks is entered at its start alone, so that one without a blank after it is scanned once.
SENTENCE = re.compile(r"(?<![.!?])[.!?]++\s+|\n+")
#: Single characters with blanks or marks between them ("i d i o t", "i.d.i.o.t") read as one word. No character is both, and each
#: is known to stand alone before the next is looked for, so nothing is ever taken back.
SPELLED = re.compile(r"(?<![^\W_])[^\W_](?:[\s.*_\-]{1,2}+[^\W_](?![^\W_])){2,}+")
TRIM = ".,!?;:\"'()[]{}|*_-"
ADDED = ("held_out", "score", "predicted")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.split(text) if s.strip()]


def words(text: str) -> set[str]:
    """Distinct lower-case words of a text, spelled-out words among them."""
    low = text.lower()
    found = set(low.split())
    for m in SPELLED.finditer(low):
        found.add("".join(c for c in m[0] if c.isalnum()))
    return found


@dataclass
class Machine:
    """The trained decision: Nystroem landmarks folded into one weight for each kernel feature."""

    weight: np.ndarray
    bias: float
    slope: float
    offset: float

    def digest(self) -> str:
        """Names this machine: workers live longer than one of the driver's objects, whose address may be used again."""
        return hashlib.sha256(np.append(self.weight, [self.bias, self.slope, self.offset]).tobytes()).hexdigest()

    def decide(self, distinct: list[str]) -> np.ndarray:
        """Decision value of each word; a long word's is the largest of its pieces'."""
        cut = [ssk.pieces(w.strip(TRIM)) for w in distinct]
        flat = [p for parts in cut for p in parts]
        value = ssk.project(flat, self.weight[:, None])[:, 0] + self.bias if flat else np.zeros(0)
        if len(flat) == len(cut):
            return value
        first = np.cumsum([0, *map(len, cut)])[:-1]
        return np.maximum.reduceat(value, first)


def _svm(x: np.ndarray, pos: np.ndarray, neg: np.ndarray, ridge: float = 0.1, steps: int = 30, chunk: int = 16_384) -> np.ndarray:
    """Linear SVM with squared hinge: row i is a positive with weight pos[i] and a negative with neg[i]; the last weight is the bias."""
    w = np.zeros(x.shape[1] + 1)
    reg = np.full(len(w), ridge)
    reg[-1] = 1e-3
    for _ in range(steps):
        grad, hess = reg * w, np.diag(reg)
        for at in range(0, len(x), chunk):
            part = np.column_stack([x[at : at + chunk], np.ones(min(chunk, len(x) - at))])
            f = part @ w
            a, b = np.where(f < 1, pos[at : at + chunk], 0.0), np.where(f > -1, neg[at : at + chunk], 0.0)
            grad += part.T @ (a * (f - 1) + b * (f + 1))
            hess += (part * (a + b)[:, None]).T @ part
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _platt(value: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of the logistic that maps decision values to probabilities."""
    x, n1, n0 = np.column_stack([value, np.ones(len(value))]), label.sum(), (1 - label).sum()
    goal = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    w = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.linalg.solve(h, x.T @ (p - goal) + 1e-3 * (w - [1.0, 0.0]))
    return max(float(w[0]), 1e-3), float(w[1])


def _landmarks(vocabulary: list[str], parts: tuple[tuple[np.ndarray, int], ...], most: int, apart: float = 0.7) -> np.ndarray:
    """Unit feature vectors of up to ``most`` words: from each part's order those unlike all taken so far, until its bound is met."""
    mark, taken = np.zeros((most, ssk.DIM), dtype=np.float32), 0
    for order, upto in parts:
        for a in range(0, len(order), 64):
            some = [vocabulary[i] for i in order[a : a + 64] if len(vocabulary[i]) >= ssk.P]
            for v in ssk.dense(some) if some and taken < upto else ():
                if taken < upto and v.any() and (not taken or (mark[:taken] @ v).max() < apart):
                    mark[taken], taken = v, taken + 1
            if taken >= upto:
                break
    return mark[:taken]


def train(texts: list[str], labels: list[int], landmarks: int = 128, rounds: int = 3) -> Machine:
    """Train on documents' sentences, each with its document's label.

    A sentence is a bag of words (long ones in the overlapping pieces that scoring uses, so whole) and its value that of its strongest
    word. Landmarks are the words that speak most for either label and are unlike each other, filled up with common ones. All
    sentences of a negative document are negative. A positive one at first lends its label to all its sentences through the words that
    its label favours; then, in each round, to those whose strongest word the last machine put above -0.5. All distinct words
    are rows of the machine.
    """
    where: dict[str, int] = {}
    cut = lambda s: (p for w in words(s) for p in ssk.pieces(w.strip(TRIM)) if p)
    bags = [[np.array(sorted({where.setdefault(p, len(where)) for p in cut(s)}), dtype=np.int32) for s in sentences(t)] for t in texts]
    docs = [np.unique(np.concatenate(b)) if b else np.empty(0, np.int32) for b in bags]
    y, vocabulary = np.array(labels), list(where)
    cp, cn = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for d, label in zip(docs, y, strict=True):
        (cp if label else cn)[d] += 1
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    if not vocabulary or not cp.any() or not cn.any():
        prior = float(np.clip((y.sum() + 1) / (len(y) + 2), 0.01, 0.99))
        return Machine(np.zeros(ssk.DIM), 0.0, 1.0, float(np.log(prior / (1 - prior))))
    odds = np.log((cp + 0.5) / n1) - np.log((cn + 0.5) / n0)
    order = np.lexsort((vocabulary, -odds * np.sqrt(np.minimum(cp, 50))))
    common = np.lexsort((vocabulary, -cn))
    mark = _landmarks(vocabulary, ((order, landmarks * 3 // 4), (common, landmarks)), landmarks)
    gram = (mark @ mark.T).astype(np.float64)
    values, vectors = np.linalg.eigh(gram)
    keep = values > 1e-6 * max(values.max(), 1e-12)
    root = vectors[:, keep] / np.sqrt(values[keep])
    table = np.ascontiguousarray(mark.T)
    z = np.empty((len(vocabulary), root.shape[1]), dtype=np.float32)
    for a in range(0, len(vocabulary), 1024):
        z[a : a + 1024] = ssk.project(vocabulary[a : a + 1024], table) @ root
    del table
    np_, nn = np.zeros(len(vocabulary)), np.zeros(len(vocabulary))
    for b, label in zip(bags, y, strict=True):
        for s in b:
            (np_ if label else nn)[s] += 1
    np_ *= odds > np.log(2)  # a witness is at least twice as frequent under the label
    f = None
    for _ in range(rounds):
        if f is not None:
            np_ = np.zeros(len(vocabulary))
            for b, label in zip(bags, y, strict=True):
                if label:
                    for s in b:
                        if len(s) and f[s].max() > -0.5:
                            np_[s[f[s] >= min(0.0, f[s].max())]] += 1
        if not np_.any():
            break
        w = _svm(z, np_, nn)
        f = z @ w[:-1] + w[-1]
    weight = mark.T.astype(np.float64) @ (root @ w[:-1])
    weight[0] = 0.0
    value = ssk.project(vocabulary, weight[:, None])[:, 0] + w[-1]
    top = np.array([value[d].max() if len(d) else w[-1] for d in docs])
    slope, offset = _platt(top, y)
    return Machine(weight, float(w[-1]), slope, offset)


#: What a Python worker remembers of words' values, by the digest of the machine that gave them.
_KNOWN: dict[str, dict[str, float]] = {}


def _scorer(machine, version: str, most: int = 600_000):
    def run(batch: pd.DataFrame) -> list[np.ndarray]:
        m = machine.value
        if version not in _KNOWN:
            _KNOWN.clear()
        known = _KNOWN.setdefault(version, {})
        bags = [words(t) for t in batch["text"]]
        if len(known) > most:
            known.clear()
        new = [w for w in set().union(*bags) if w not in known]
        known.update(zip(new, m.decide(new).tolist(), strict=True))
        top = np.array([max(map(known.__getitem__, b), default=m.bias) for b in bags])
        return [1 / (1 + np.exp(-np.clip(m.slope * top + m.offset, -30, 30)))]

    return run


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = 3000) -> Machine:
    """Train on at most ``sample`` labelled documents (the smallest hashes), never on held-out ids.

    Two in five of the sample are positive ones, as far as there are so many. An id with several labels counts as its larger one; null labels and ids are left out.
    """
    usable = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = usable.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("y")).withColumn("o", F.xxhash64("id"))
    picked = [r for y, n in ((1, sample * 2 // 5), (0, sample * 3 // 5)) for r in known.where(F.col("y") == y).orderBy("o", "id").limit(n).collect()]
    want = F.broadcast(docs.sparkSession.createDataFrame([(r["id"], r["y"]) for r in picked], "id long, y int"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_of(text_col).alias("text")).join(want, "id")
    one = rows.groupBy("id").agg(F.min(F.struct("text", "y")).alias("r")).orderBy("id")  # a row an id, however often it occurs
    found = [(r["r"]["text"], r["r"]["y"]) for r in one.toLocalIterator()]
    return train([t for t, _ in found], [y for _, y in found])


def score_toxicity(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``held_out, score, predicted``; scores rest on the whole text and nothing else.

    Each distinct word is scored once for each Python worker. A subsequence of three letters counts up to a span of ``ssk.SPAN`` characters
    (wider ones weigh under 3 per cent), and words are compared on their own, spelled-out ones joined: an insult
    broken by one blank into longer parts is two words here. Defined cases: null and empty texts get the score of
    no words; null ids pass through; repeated rows score alike; columns named like an added one are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = without(docs, *ADDED)
    shared = spark.sparkContext.broadcast(machine)
    # A table of ids and texts alone gives back its ids; any other all its columns.
    carry = base.columns if set(base.columns) - {id_col, text_col} else [id_col]
    scored = with_scores(base, carry, [text_of(text_col).alias("text")], _scorer(shared, machine.digest()), ["score"])
    return scored.withColumn("held_out", held_out(F.col(id_col))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
