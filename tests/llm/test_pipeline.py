"""Stages of the corpus pipeline on small fixtures."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm import near_dedup
from folioflow.llm.hyperminhash import BANDS, REGISTERS, ROWS, band_keys, few_keys

from . import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def numbered(tag, n):
    return [f"{tag}w{i}" for i in range(n)]


def doc(i, words, lang="en", source="s"):
    text = " ".join(words)
    return (i, text, lang, source, len(text))


def test_near_stage_links_from_0_80(spark):
    """16 of 20 and 4 of 5 shingles shared are near copies, 3 of 4 and 15 of 20 are not."""
    rows, want = [], []
    for k in range(20):
        base, tail = numbered(f"a{k}", 22), [f"x{k}", f"y{k}"]
        rows += [doc(100 * k + 1, base), doc(100 * k + 2, base[:20] + tail)]
        short = numbered(f"b{k}", 9)
        rows += [doc(100 * k + 11, short), doc(100 * k + 12, short[:8])]
        less = numbered(f"c{k}", 8)
        rows += [doc(100 * k + 21, less), doc(100 * k + 22, less[:7])]
        far = numbered(f"d{k}", 22)
        rows += [doc(100 * k + 31, far), doc(100 * k + 32, far[:19] + tail)]
        want += [100 * k + i for i in (1, 11, 21, 22, 31, 32)]
    kept = corpus_pipeline.near(spark, spark.createDataFrame(rows, DOCS), None)
    assert sorted(r.doc_id for r in kept.collect()) == want


def test_bands_are_sized_for_0_80():
    assert (1 - 0.8**ROWS) ** BANDS < 1e-8
    a = np.zeros((2, REGISTERS), dtype=np.uint16)
    a[:, :ROWS] = 7
    a[1, 2] = 0
    keys, used = band_keys(a)
    assert not set(keys[0][used[0]]) & set(keys[1][used[1]])
    rows, few = few_keys(a)
    assert set(few[rows == 0]) & set(few[rows == 1])


def repeated_rows():
    """Null ids and one repeated id on unlike texts; some of them near a numbered text, or near each other."""
    rows, near = [], []
    for k in range(8):
        base = numbered(f"n{k}", 60)
        rows.append((None, base))
        if k % 2 == 0:
            rows.append((10 + k, base[:59]))
        if k % 4 == 1:
            rows.append((None, base[1:]))
        other = numbered(f"r{k}", 60)
        rows.append((7, other))
        if k % 2:
            rows.append((3 if k == 1 else 20 + k, other[:59]))
    rows += [(None, numbered("n0", 60)), (7, numbered("r1", 60)), (None, []), (7, [])]
    return [(i, " ".join(w)) for i, w in rows]


def test_null_and_repeated_ids_go_by_their_own_text(spark):
    rows = repeated_rows()
    sets = [brute.shingle_set(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    comp, least = brute.components(len(rows), links), {}
    for (i, _), c in zip(rows, comp, strict=True):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    want = sorted(((i, t, len(s), least.get(c), i == least.get(c)) for (i, t), s, c in zip(rows, sets, comp, strict=True)), key=str)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = near_dedup.near_duplicates(docs, percent=85)
    assert sorted((tuple(r) for r in plain.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str) == sorted((x[:1] + x[2:] for x in want), key=str)
    carried = near_dedup.near_duplicates(docs.select("*", F.lit(1).alias("more")), percent=85)
    assert sorted((tuple(r) for r in carried.select("doc_id", "text", "n_shingles", "component_id", "kept").collect()), key=str) == want
