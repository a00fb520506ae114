"""Piece agenda, pair whitening and fill-in-the-middle against plain versions, and their awkward cases."""

import hashlib
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioflow.llm import fill_in_middle, piece_bpe, pii, queries, sharding, toxicity, whitening

from . import brute
from .test_edges import DOCS, clashing, odd_rows

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), DOCS)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=queries.piece_bpe())


# Pieces ---------------------------------------------------------------------------------------------------------------

SIGNS = " ▁  abcdefghijklmnopqrstuvwxyzétheanding\n\t0123.,<>/s\x00é😀漢字한ß​﻿  "


def test_agenda_is_the_library(library):
    own, rng = piece_bpe.Agenda(queries.piece_bpe()), random.Random(1)
    texts = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(4000)] + [" ", "  ", "▁", "x" * 5000, "a b" * 2000, "é" * 3000, "\n" * 200]
    for t in texts:
        ids = own.encode(t).tolist()
        assert ids == library.encode(t), t
        assert own.decode(ids) == (library.decode(ids) if ids else ""), t


def test_list_and_heap_agendas_agree():
    own, rng = piece_bpe.Agenda(queries.piece_bpe()), random.Random(2)
    for _ in range(3000):
        chunk = "".join(rng.choice("  theinganrol") for _ in range(rng.randint(1, 60)))
        assert own._few(chunk) == own._many(chunk)


def words(rng, n, letters="theinganrolé,"):
    return [" " * rng.randint(0, 2) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 20))) for _ in range(n)]


def test_agendas_side_by_side_are_the_agenda():
    """Also with many equal scores, and with a character that stands in pieces but is none."""
    own, rng = piece_bpe.Agenda(queries.piece_bpe()), random.Random(4)
    chunks = words(rng, 5000) + [" ", "\n\n", "x", "😀", "a\nb", "an" * 24]
    for score in (own.score, {p: round(s / 5000) for p, s in own.score.items()}):
        own.score = score
        own.pairs = piece_bpe.Pairs(own.number, score)
        for chunk, ids in zip(chunks, own.side_by_side(chunks), strict=True):
            assert ids == (None if any(c not in own.number for c in chunk) else b"".join(own.number[p] for p in own._many(chunk))), chunk
    del own.number["h"]
    own.pairs = piece_bpe.Pairs(own.number, own.score)
    assert [ids is None for ids in own.side_by_side(chunks)] == [any(x not in own.number for x in c) for c in chunks]


def test_chunks_end_where_they_did(library):
    own, rng = piece_bpe.Agenda(queries.piece_bpe()), random.Random(5)
    texts = ["".join(words(rng, 200, SIGNS)) for _ in range(40)] + ["", "\n", " ", "😀" * 90]
    for text, ids, theirs in zip(texts, own.encode_all(texts), library.encode(texts), strict=True):
        assert ids.tolist() == theirs, text
    every = own.encode_all(texts)
    assert own.decode_all(every) == [library.decode(i.tolist()) if len(i) else "" for i in every]


def test_letters_and_signs_that_no_vocabulary_here_has():
    """A character that may follow a letter but is none keeps what stands behind it in the chunk."""
    cuts = piece_bpe.Agenda._cuts(["ab", "b'", "'c", ".c", " a"])
    assert cuts.findall(" ab'c.a ab.c  c.. é") == [" ab'c.a", " ab", ".c", "  c", "..", " ", "é"]


def test_new_words_cost_less_than_agendas_one_by_one():
    """The check's prose has one new word in ten, each of which had an agenda of its own."""
    rng = random.Random(6)
    text = "".join(sorted({" " + w.strip() for w in words(rng, 20_000, "theinganrol")}))
    shares = []
    for _ in range(3):
        own = piece_bpe.Agenda(queries.piece_bpe())
        chunks = own.chunks.findall(text)
        start = time.process_time()
        own.encode(text)
        whole = time.process_time() - start
        for c in chunks:
            own._few(c)
        shares.append(whole / (time.process_time() - start - whole))
    assert min(shares) < 0.6


def test_memory_of_chunks_is_bounded(monkeypatch, library):
    monkeypatch.setattr(piece_bpe, "MOST", 50)
    own, rng = piece_bpe.Agenda(queries.piece_bpe()), random.Random(3)
    for _ in range(200):
        t = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(20))
        assert own.encode(t).tolist() == library.encode(t)
    assert len(own.known) <= 50 + 20 and len(own.older) <= 50 + 20


def test_agenda_refuses_other_vocabularies(tmp_path):
    """The same file with the other type's number in it."""
    with open(queries.piece_bpe(), "rb") as f:
        raw = f.read()
    assert raw.count(b"tok_v0\x18\x02") == 1
    (tmp_path / "other.model").write_bytes(raw.replace(b"tok_v0\x18\x02", b"tok_v0\x18\x01"))
    with pytest.raises(ValueError):
        piece_bpe.Agenda(str(tmp_path / "other.model"))


def test_encode_pieces(docs, library):
    out = piece_bpe.encode_pieces(clashing(docs).withColumn("IDS", F.lit(1)), queries.piece_bpe())
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    rows = out.collect()
    want = sorted(((r[0], library.encode(r[1] or "")) for r in odd_rows()), key=str)
    assert sorted(((r.doc_id, list(r.ids)) for r in rows), key=str) == want
    assert all(r.agrees and r.decoded == (library.decode(list(r.ids)) if r.ids else "") for r in rows)
    assert piece_bpe.encode_pieces(docs.limit(0), queries.piece_bpe()).count() == 0


def test_op11_columns(spark, library):
    rows = {r.doc_id: r for r in queries.op11_piece_agenda(spark, SF).collect()}
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids, r = library.encode(text or ""), rows[doc_id]
        assert r.agrees and (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else ""))


# Whitening ------------------------------------------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def whitened_plainly(rows, most=16):
    """The contract, in NumPy: sound rows, their integers, statistics over distinct ones."""
    sound = [(i, tuple(int(np.floor(64 * float(c))) + 1_000_000 for c in v)) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = np.array(sorted({x for _, x in sound}), dtype=np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in sound:
        dev = sum((n * a - int(s)) ** 2 for a, s in zip(x, sums))
        out.setdefault(i, []).append((n, dev, (np.array(x) - sums / n) @ axes[:, :most] / np.sqrt(values[:most]), values[:most] / values.sum()))
    return out


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 20)) * np.linspace(1, 3, 20)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(100 + i, rows[3][1]) for i in range(30)] + [(3, rows[3][1]), (7, rows[8][1])]  # a third are copies of one
    bad = [(900, None), (901, [float("nan")] + [1.0] * 19), (902, [float("inf")] * 20), (903, [None] + [1.0] * 19)]
    want = whitened_plainly(rows + bad)
    got = {}
    for r in whitening.whiten(vectors(spark, rows + bad)).collect():
        got.setdefault((r.vec_id, r.component), []).append(r)
    assert {i for i, _ in got} == set(want) and {k for _, k in got} == set(range(1, 17))
    signs = np.sign([got[0, k][0].whitened * want[0][0][2][k - 1] for k in range(1, 17)])
    for (i, k), found in got.items():
        assert len(found) == len(want[i])
        plain = sorted(float(signs[k - 1] * w[2][k - 1]) for w in want[i])
        assert np.allclose(sorted(r.whitened for r in found), plain, atol=1e-9)
        assert sorted((r.n, r.deviation) for r in found) == sorted(w[:2] for w in want[i])
        assert all(abs(r.explained - want[i][0][3][k - 1]) < 1e-12 and r.identity_error < 1e-9 for r in found)


def test_whitening_of_awkward_tables(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None), (2, []), (None, [float("nan")])])).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0])])).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.identity_error is None and r.n == 1 and r.deviation == 0 for r in one)
    mixed = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0]), (3, [1.0]), (4, [2.0, -1.0])])).collect()
    assert {r.vec_id for r in mixed} == {1, 2, 4} and {r.component for r in mixed} == {1, 2}
    flat = whitening.whiten(vectors(spark, [(i, [float(i), float(i), 7.0]) for i in range(5)])).collect()  # one direction only
    assert all((r.whitened is None) == (r.component > 1) for r in flat) and flat[0].identity_error < 1e-9
    extra = vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 5.0])]).select("*", F.lit(1).alias("n"), F.lit(1).alias("Component"), F.lit(1).alias("x"))
    assert whitening.whiten(extra).count() == 4


def test_op12_on_the_table(spark):
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want = whitened_plainly(table)
    for r in queries.op12_pair_whitening(spark, SF).where("vec_id % 50 = 0").collect():
        n, deviation, w, share = want[r.vec_id][0]
        assert (r.n, r.deviation) == (n, deviation) and abs(abs(r.whitened) - abs(w[r.component - 1])) < 1e-6
        assert abs(r.explained - share[r.component - 1]) <= 1e-4 * share[r.component - 1] and r.identity_error <= 1e-4


# Fill in the middle ----------------------------------------------------------------------------------------------------

def middle_plainly(doc_id, text):
    text = text or ""
    unit = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(unit), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(unit[:a]), "".join(unit[a:b]), "".join(unit[b:])
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


ODD = ["a\nb\r\n", "x\x00y", "😀é<P>b", "a <", "<S", "S> <", "P><M", "<<S><M>", "漢字" * 40, "é" * 9, " ", "a" * 30_000, "ab cd, ef! " * 20_000]


def test_fill_in_middle(spark, docs):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(5000 + 40 * i + k, t) for i, t in enumerate(ODD) for k in range(12)]
    table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("Form", F.lit("mine")).withColumn("row", F.lit(1))
    out = fill_in_middle.fill_in_middle(table)
    assert len({c.lower() for c in out.columns}) == len(out.columns) and "row" in out.columns
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out.collect()), key=str)
    assert got == sorted(((i, *middle_plainly(i, t)) for i, t in rows), key=str)
    assert {r.form for r in out.select("form").distinct().collect()} == {"plain", "spm", "psm"}
    assert out.where("NOT (restored <=> coalesce(text, '')) OR restored_sha256 <> sha2(coalesce(text, ''), 256) OR output_sha256 <> sha2(output, 256)").count() == 0
    assert fill_in_middle.fill_in_middle(docs.limit(0)).count() == 0


# Mended operators --------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("text", ["_" * 10_000 + "ab", ". " * 10_000 + "ab", "." * 200_000 + "x", "a_ " * 50_000 + "!", "a_b_c_" * 30_000, "-_*. " * 30_000 + "ab", "?" * 100_000], ids=range(7))
def test_form_lines_take_no_time(text):
    start = time.perf_counter()
    toxicity.words(text)
    toxicity.sentences(text)
    assert time.perf_counter() - start < 2


def test_spelled_out_words():
    assert "idiot" in toxicity.words("you i d i o t you") and "idiot" in toxicity.words("i.d.i.o.t!") and "idiot" in toxicity.words("(i_d_i_o_t)")
    assert not {"ab", "aword"} & toxicity.words("a b word") and "idiot" not in toxicity.words("xi d i o tx")


@pytest.mark.parametrize("text", ["_" * 10_000 + "ab", "+1 (" * 5000, "Mr. " * 5000, "AB12 " * 5000, "a:b:" * 5000, "00" * 10_000, "password " * 3000, "1 Ab " * 4000, "a(at)" * 4000], ids=range(9))
def test_personal_data_patterns_take_no_time(spark, text):
    start = time.perf_counter()
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.base_sha256 == brute.personal(text)[1] and time.perf_counter() - start < 40


def test_a_hundred_thousand_addresses(spark):
    text = "".join(f"user{i}@mail{i % 7}.org, 10.0.{i % 256}.7 x\n" for i in range(100_000))
    row = pii.find_personal_data(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (row.n_email, row.n_ip) == (100_000, 100_000) and row.base_sha256 == brute.personal(text)[1]


def test_blocks_of_matches_are_one_walk(spark, monkeypatch):
    text = " ".join(f"call a{i}@b.co é{'x' * (i % 50)}" for i in range(700))
    table = spark.createDataFrame([(text,)], "t string")
    seen = []
    for block in (3, 128, 10_000):
        monkeypatch.setattr(pii, "BLOCK", block)
        seen.append(table.select(pii.located(F.col("t"), pii.BASE["email"], F.lit(True)).alias("x")).first().x)
    assert seen[0] == seen[1] == seen[2] and all(r.left == text[max(0, r.s - 32) : r.s] and r.m == text[r.s : r.e] for r in seen[0])


def test_two_thousand_shards(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "the same text").otherwise(F.repeat(F.lit("w "), (F.col("id") % 90).cast("int") + 1)).alias("text"))
    out = sharding.histogram_shards(docs, 2000).select("doc_id", "text", "size", "shard", "slot").toPandas()
    assert len(out) == 6000 and out["doc_id"].is_unique and out["shard"].between(0, 1999).all()
    assert (out.groupby("shard")["slot"].apply(lambda s: sorted(s) == list(range(len(s))))).all()
    assert out.groupby("shard")["size"].sum().max() <= out["size"].sum() / 2000 + 2 * out["size"].max()
