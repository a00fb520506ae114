"""Stage wrappers and whole runs against plain versions: callers' columns, null and repeated ids, repeated rows."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioflow.llm._common import written
from folioflow.llm import embedding_dedup, exact_dedup, mixing, near_dedup, packing, quality, queries

from . import brute
from .test_edges import DOCS, clashing, norm, odd_rows, prose

BIG = (1 << 63) - 1


def numbered(tag, n):
    return [f"{tag}w{i}" for i in range(n)]


def plain(rows):
    return Counter(tuple(r) for r in rows)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, i % 2, i % 2) for i in range(20)], "doc_id long, quality int, toxic int")


def awkward():
    """Texts that differ in blanks under one id, full repeats, null ids, and near copies of them."""
    base, other = numbered("a", 40), numbered("b", 40)
    return [
        (1, "a b", "en", "s", 3), (1, "ab", "en", "s", 2), (1, "a b", "en", "s", 3), (2, "ab", "en", "s", 2),
        (5, " ".join(base), "en", "s", 1), (None, " ".join(base[:39]), "en", "s", 1), (None, " ".join(other), "en", "s", 1), (None, "unlike all the rest of these words", "en", None, None),
        (7, " ".join(other[:39]), "en", "s", 1), (7, " ".join(other[:39]), "en", "s", 1), (BIG, "the largest id that there is", "en", "s", 1), (9, None, "en", "s", 0), (None, "", None, None, None),
    ]


def test_exact_stage_keeps_one_row_a_group(spark):
    rows = awkward() + odd_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    got = exact_dedup.keep_first_copies(docs)
    assert got.columns == docs.columns
    groups = {}
    for r in docs.collect():
        groups.setdefault(norm(r.text), []).append(r)
    best = {k: min(v, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)) for k, v in groups.items()}
    kept = got.collect()
    assert Counter(norm(r.text) for r in kept) == Counter(groups.keys())
    for r in kept:
        want = best[norm(r.text)]
        assert (r.doc_id, len(r.text or ""), r.size, r.Kept, r.id) == (want.doc_id, len(want.text or ""), "mine", "mine", "mine")


def near_brute(rows, percent):
    sets = [brute.shingle_set(r[1]) for r in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, brute.components(len(rows), links)


def test_near_stage_keeps_one_row_a_component(spark):
    rows = awkward() + odd_rows()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    got = near_dedup.keep_one_of_each(docs)
    assert got.columns == docs.columns
    sets, comp = near_brute(rows, 80)
    want, empty = {}, []
    for (i, t, *_), s, c in zip(rows, sets, comp, strict=True):
        if s:
            want.setdefault(c, []).append((i is None, i or 0))
        else:
            empty.append(i)
    kept = got.collect()
    ids = [r.doc_id for r in kept if brute.shingle_set(r.text)]
    assert sorted(ids, key=str) == sorted((None if min(v)[0] else min(v)[1] for v in want.values()), key=str)
    assert sorted((r.doc_id for r in kept if not brute.shingle_set(r.text)), key=str) == sorted(empty, key=str)
    assert {(r.Kept, r.size, r.id, r.component_id) for r in kept} == {("mine",) * 4}


def test_near_duplicates_of_null_and_repeated_ids(spark):
    """Unlike texts that only share an id, or have none, are never one component."""
    a, b, c = numbered("a", 40), numbered("b", 40), numbered("c", 40)
    rows = [(5, a), (None, a[:39]), (None, b[:39]), (None, c), (7, b), (8, a[1:]), (8, numbered("d", 40)), (9, numbered("d", 39)), (BIG, numbered("e", 30))]
    rows = [(i, " ".join(w)) for i, w in rows]
    _, comp = near_brute(rows, 80)
    least = {}
    for (i, _), k in zip(rows, comp, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").withColumn("id", F.lit("mine"))).collect()
    assert plain((r.text, r.doc_id, r.component_id, r.kept, r.id) for r in got) == plain((t, i, least.get(k), i == least.get(k), "mine") for (i, t), k in zip(rows, comp, strict=True))


def test_blocks_meet_by_size(spark, monkeypatch):
    """Members of one hub whose sizes differ too much meet in no task; links among those of like size are all found."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    rng, rows = random.Random(3), []
    head = numbered("h", 30)
    for i in range(120):
        n = rng.choice((30, 60, 120, 300))
        body = numbered(f"g{i % 5}x{n}", n)
        body[rng.randrange(n)] = f"odd{i}"
        rows.append((i, " ".join(head + body)))
    _, comp = near_brute(rows, 80)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "component_id").collect()
    assert sorted(map(tuple, got)) == list(enumerate(comp))


def test_meetings_do_not_grow_with_unlike_sizes(spark):
    sides = [(1, i, i, i > 0, 10 * 2 ** (i % 12)) for i in range(6000)]
    df = spark.createDataFrame(sides, "hub long, cid long, comp long, apart boolean, n long")
    copies = near_dedup._meetings(df, 80).count()
    assert copies <= 6000 * 3  # a dozen blocks of 500 each: all with all would be 6000 * 12


def test_embeddings_with_null_and_repeated_ids(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    rows, near = [], lambda v: [float(x) for x in np.float32(np.array(v) + rng.normal(size=12) * 0.01)]
    for label in range(1, 5):
        base = [float(x) for x in np.float32(rng.normal(size=12))]
        rows += [(1, base, label), (10 * label, near(base), label)] if label < 3 else [(None, base, label), (10 * label, near(base), label)]
    rows += [(BIG, [1.0] + [0.0] * 11, 9), (None, None, 3), (77, rows[0][1], None)]
    x = [None if v is None or label is None else np.array(v, dtype=np.float32).astype(float) for _, v, label in rows]
    cos = lambda a, b: float(a @ b / np.sqrt((a @ a) * (b @ b)))
    links = [(a, b) for a in range(len(rows)) for b in range(a) if x[a] is not None and x[b] is not None and rows[a][2] == rows[b][2] and cos(x[a], x[b]) >= 0.98]
    comp, least = brute.components(len(rows), links), {}
    for (i, *_), k in zip(rows, comp, strict=True):
        if i is not None:
            least[k] = min(i, least.get(k, i))
    want = plain((i, label, sum(n in p for p in links), least.get(k), i == least.get(k)) for n, ((i, _, label), k) in enumerate(zip(rows, comp, strict=True)))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = embedding_dedup.embedding_duplicates(df).select("vec_id", "label", "n_links", "component_id", "kept").collect()
    assert Counter((r[0], r[1], r[2], r[3], bool(r[4])) for r in got) == Counter((a, b, c, d, e if d is not None else a is None) for (a, b, c, d, e) in want.elements())


def test_one_graph_a_shard_serves_every_query(spark):
    """A label of several shards: each pair of vectors is searched once, and audits are reported."""
    import numpy as np

    rng = np.random.default_rng(9)
    centres = rng.normal(size=(20, 16))
    x = np.float32(centres[rng.integers(0, 20, 900)] + rng.normal(size=(900, 16)) * 0.06)
    df = spark.createDataFrame([(i, [float(c) for c in v], 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    true = (u @ u.T >= 0.98).sum(axis=1) - 1
    got = embedding_dedup.embedding_duplicates(df, shard=64).select("vec_id", "n_links").collect()
    assert [n for _, n in sorted(map(tuple, got))] == true.tolist()
    keyed = df.select(F.col("label").cast("string").alias("__l"), F.col("vec_id").cast("string").alias("__d"), F.col("embedding").cast("array<double>").alias("__v"), F.col("vec_id").alias("id"))
    _, found = embedding_dedup._found(keyed, 0.98, 0.999, 64)
    shards = -(-900 // 64)
    assert found.where("cid < 0").count() == shards * (shards + 1) // 2
    assert found.where("cid < 0").agg(F.sum("root")).first()[0] == true.sum() // 2


def test_mixing_keeps_columns_and_lands_close(spark):
    rng = random.Random(4)
    rows = [(i, prose(i, rng.choice((3, 8, 20, 60, 400))), "en", rng.choice(("a", "a", "a", "b", "c", None)), 1) for i in range(1500)] + awkward()
    docs = clashing(spark.createDataFrame(rows, DOCS))
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns and {r.size for r in got.select("size").distinct().collect()} == {"mine"}
    taken, sizes = Counter(), {}
    for r in got.collect():
        taken[r.source] += len((r.text or "").split())
    for _, t, _, s, _ in rows:
        sizes.setdefault(s, []).append(len((t or "").split()))
    want = mixing.targets({s: sum(v) for s, v in sizes.items()})
    for s, v in sizes.items():
        if len(v) > 50:
            assert abs(taken[s] - want[s]) <= sorted(v)[len(v) // 2] / 2
    marked = mixing.mix_sources(docs).collect()
    assert {r.source: r.target for r in marked} == pytest.approx(want) and all(r.taken == r.copies * r["size"] for r in marked)


def test_only_fractional_documents_are_balanced(spark, monkeypatch):
    """One source alone, or one capped at three times its size, has nothing to balance: no group goes through Python."""
    seen = []
    monkeypatch.setattr(mixing, "_balance", lambda last, seed: seen.append(last))
    one = spark.createDataFrame([(i, "w " * (i % 7), "only") for i in range(5000)], "doc_id long, text string, source string")
    assert mixing.mix_sources(one).where("taken <> size").count() == 0 and not seen


def test_blocks_of_a_large_source_are_bounded(spark, monkeypatch):
    """No group that is balanced at a time holds more than about twice ``BLOCK`` documents, whatever a source's share."""
    monkeypatch.setattr(mixing, "BLOCK", 64)
    held, plan = [], mixing._balance

    def watched(last, seed):
        run = plan(last, seed)
        return lambda key, units: run(key, units.assign(size=units["size"])) if len(units) <= 2 * 64 else (_ for _ in ()).throw(AssertionError(len(units)))

    monkeypatch.setattr(mixing, "_balance", watched)
    rows = [(i, "w " * (1 + i % 9), "big" if i % 3 else f"s{i % 7}") for i in range(4000)]
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    per = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("w"), F.max("size").alias("m")).collect()
    assert len(per) == 8 and all(abs(r.t - r.w) <= r.m for r in per) and not held


def test_quality_stage_keeps_columns(spark, labels):
    docs = clashing(spark.createDataFrame(odd_rows(), DOCS))
    model = quality.fit_quality(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score_quality(spark.createDataFrame(odd_rows(), DOCS), model).collect() if r.doc_id is not None}
    got = quality.keep_good(docs, labels)
    assert got.columns == docs.columns
    kept = got.collect()
    assert {r.doc_id for r in kept if r.doc_id is not None} == {i for i, s in scores.items() if s >= 0.5} and {r.score for r in kept} <= {"mine"}


def test_run_against_a_plain_version(spark, tmp_path):
    """Every stage's decisions on small tables, stage by stage, each on what the one before it kept."""
    rng, rows = random.Random(11), []
    for i in range(240):
        good = i % 4 != 0
        text = prose(i, rng.randint(30, 90)) if good else "!!! ".join(prose(i, 30).upper().split()) + "###"
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
    for i in range(0, 40):
        words = rows[4 * i + 1][1].split()
        rows.append((1000 + i, " ".join(words) + "\n" if i % 2 else " ".join(words[:-1]), "en", "s1", 5))
    rows += [(None, rows[1][1], "en", "s0", 3), rows[2], rows[2]]
    labels = [(i, int(i % 4 != 0), 0) for i in range(240) if i % 3]
    at = str(tmp_path)
    spark.createDataFrame(rows, DOCS).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    docs = spark.read.parquet(f"{at}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]

    good = written(stages["quality"](spark, docs, at), "test")
    kept = good.collect()
    assert good.columns == docs.columns
    assert all((r.doc_id is None or r.doc_id >= 1000 or r.doc_id % 4 != 0) for r in kept) and len(kept) == sum(i is None or i >= 1000 or i % 4 != 0 for i, *_ in rows)

    exact = written(stages["exact_dedup"](spark, good, at), "test")
    assert sorted(norm(r.text) for r in exact.collect()) == sorted({norm(r.text) for r in kept})

    near = written(stages["near_dedup"](spark, exact, at), "test")
    left = exact.collect()
    _, comp = near_brute([(r.doc_id, r.text) for r in left], 80)
    want = {}
    for r, c in zip(left, comp, strict=True):
        want.setdefault(c, []).append((r.doc_id is None, r.doc_id or 0))
    assert sorted((r.doc_id for r in near.collect()), key=str) == sorted((None if min(v)[0] else min(v)[1] for v in want.values()), key=str)

    mixed = written(stages["mixing"](spark, near, at), "test")
    sizes, taken = Counter(), Counter()
    for r in near.collect():
        sizes[r.source] += len(r.text.split())
    for r in mixed.collect():
        taken[r.source] += len(r.text.split())
    assert all(abs(taken[s] - w) <= 60 for s, w in mixing.targets(dict(sizes)).items())

    tok = packing.WordEncoder(queries.word_bpe()).tokenizer
    tokens = Counter((r.doc_id, len(tok.encode(r.text, add_special_tokens=False).ids) + 1) for r in mixed.collect())
    packed = stages["packing"](spark, mixed, at).collect()
    assert Counter((r.doc_id, r.doc_tokens) for r in packed if r.start == 0) == tokens
    whole = corpus_pipeline.run(spark, at).collect()
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in whole) == Counter((r.doc_id, r.start, r.ids_crc32) for r in packed)
