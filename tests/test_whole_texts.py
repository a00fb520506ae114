"""Queries over whole texts, on fixtures that a prefix or a filter would cut."""

import json

import pytest

from folioflow.plans import queries as plans

LONG = "no end in sight " * 40 + "end"
PLAIN = ["short", 'say "hi"', "back\\slash \\n \\\"", "one\ntwo\r\n\tthree", "[a] {b} ]}", "naïve 中文 😀", LONG + ' "q" \\ [z] é', ""]
#: The repair of untidy replies may alter these, that of well-formed ones may not.
CODE = ["f(x, {a: 1}, [2, ],)", "None of True, {False: NaN}"]


@pytest.fixture(scope="module")
def talks(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("talks"))
    rows = [(i, turn, t) for i, t in enumerate(PLAIN) for turn in (0, 1)] + [(100 + i, 1, t) for i, t in enumerate(CODE)]
    spark.createDataFrame(rows, "conv_id long, turn int, text string").write.parquet(f"{at}/conversations.parquet")
    return at, {r[:2]: r[2] for r in rows}


def by_turn(spark, name, at):
    rows = plans.QUERIES[name](spark, at).collect()
    out = {(r.conv_id, r.turn): r for r in rows}
    assert len(out) == len(rows)
    return out


def test_json_queries_read_whole_texts(spark, talks):
    at, texts = talks
    inner, repaired = by_turn(spark, "json_strip_fences", at), by_turn(spark, "json_repair", at)
    typed, parsed, said = (by_turn(spark, f"json_{n}", at) for n in ("typed_items", "parse_replies", "model_text"))
    assert set(inner) == set(repaired) == set(typed) == set(parsed) == set(said) == set(texts)
    for (conv, turn), t in texts.items():
        key, value = (conv, turn), {"items": [{"text": t, "translation": f"T {turn}", "box": [0, 0, 10, 10]}]}
        if turn:
            assert json.loads(inner[key].inner_text) == value
        else:
            assert inner[key].inner_text.startswith('{items:[{text:"') and inner[key].inner_text.endswith('",box:[0,0,10,10],},],}')
        if conv < 100:
            assert json.loads(repaired[key].repaired) == value
        assert (typed[key].item_no, typed[key].src, typed[key].dst, typed[key].box_sum) == (0, t, f"T {turn}", 20.0)
        assert (parsed[key].item_no, parsed[key].src, parsed[key].dst) == (0, t.strip(), f"T {turn}")
        assert said[key].said == t + "tail"


def test_flagship_translates_every_line(spark, tmp_path):
    lines = ["Hello there", "SKU-11227J", "AB-1234 costs 99", "100%", "", "3 boxes of 12 in", "中文 12", " 4'5\" and 160cm "]
    docs = [(1, "en", "\n".join(lines)), (2, "de", "\r\n".join(lines * 2))]
    spark.createDataFrame(docs, "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.lang, r.engine, r.warn): (r.n, r.texts) for r in plans.QUERIES["flagship_translation"](spark, str(tmp_path)).collect()}
    assert got == {("en", "skip", ""): (4, 4), ("en", "engine", ""): (4, 4), ("de", "skip", ""): (8, 4), ("de", "engine", ""): (8, 4)}
