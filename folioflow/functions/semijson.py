"""Tolerant reading of JSON replies: fences, prose around it, trailing commas, bare keys, renamed fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import repair_json, strip_fences

#: Names under which replies hold their parts.
LIST_KEYS = ("items", "data", "results", "list", "lines", "entries", "translations")
SOURCE_KEYS = ("text", "src", "source", "original", "en", "原文")
TARGET_KEYS = ("translation", "dst", "target", "zh", "translated", "译文")
BOX_KEYS = ("box", "bbox", "bbox_2d", "rect", "position")


def balanced(text: str, at: int) -> str | None:
    """The bracketed piece that begins at ``at``; brackets inside strings do not count."""
    depth, inside, skip = 0, False, False
    for i in range(at, len(text)):
        c = text[i]
        if inside:
            skip, inside = (c == "\\" and not skip), not (c == '"' and not skip)
        elif c == '"':
            inside = True
        elif c in "{[":
            depth += 1
        elif c in "}]":
            depth -= 1
            if not depth:
                return text[at : i + 1]
    return None


_FIXES = [(re.compile(r",\s*([}\]])"), r"\1"), *((re.compile(rf"\b{a}\b"), b) for a, b in (("None", "null"), ("True", "true"), ("False", "false"), ("NaN", "null"), ("Infinity", "null"))), (re.compile(r"([{,\[]\s*)([A-Za-z_$一-鿿][\w$]*)(\s*:)"), r'\1"\2"\3')]


def _load(text: str):
    try:
        return json.loads(text)
    except ValueError:
        return None


def extract(text: str | None):
    """The JSON value in a reply, or None: as it is, else its first bracketed piece, else that repaired."""
    text = (text or "").strip()
    fence = re.search(r"```[a-zA-Z0-9_-]*\s*(.*?)```", text, re.S)
    text = fence[1].strip() if fence and fence[1].strip() else text
    if (found := _load(text)) is not None:
        return found
    start = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    piece = (balanced(text, start) or text[start:]) if start >= 0 else None
    if piece is None:
        return None
    if (found := _load(piece)) is None:
        for pattern, put in _FIXES:
            piece = pattern.sub(put, piece)
        found = _load(piece)
    return found


def coerce_items(value) -> list[dict]:
    if isinstance(value, list):
        return [x for x in value if isinstance(x, dict)]
    if not isinstance(value, dict):
        return []
    named = [value[k] for k in LIST_KEYS if isinstance(value.get(k), list)] or [v for v in value.values() if isinstance(v, list) and any(isinstance(x, dict) for x in v)]
    if named:
        return [x for x in named[0] if isinstance(x, dict)]
    return [value] if any(k in value for k in (*SOURCE_KEYS, *TARGET_KEYS)) else []


def pick(item: dict, keys: tuple[str, ...]) -> str:
    for k in keys:
        v = item.get(k)
        if isinstance(v, dict):
            v = v.get("text") or v.get("content") or v.get("value")
        if v is not None and str(v).strip():
            return str(v).strip()
    return ""


def pick_box(item: dict) -> list[float] | None:
    for place in (*(item.get(k) for k in BOX_KEYS), item):
        if isinstance(place, list) and len(place) >= 4:
            v = place[:4]
        elif isinstance(place, dict):
            sets = (("x0", "y0", "x1", "y1"), ("left", "top", "right", "bottom"), ("x1", "y1", "x2", "y2"))
            v = next(([place[k] for k in s] for s in sets if all(k in place for k in s)), None)
            if v is None and all(k in place for k in ("x", "y")) and any(k in place for k in ("w", "width")):
                w, h = place.get("w", place.get("width")), place.get("h", place.get("height"))
                v = [place["x"], place["y"], place["x"] + w, place["y"] + h] if isinstance(w, (int, float)) and isinstance(h, (int, float)) else None
        else:
            v = None
        if v is not None:
            try:
                return [float(x) for x in v]
            except (TypeError, ValueError):
                continue
    return None


def parse_reply(text: str | None) -> list[dict]:
    """The items of a reply: source and target text, and a box that may be missing."""
    out = [{"src": pick(x, SOURCE_KEYS), "dst": pick(x, TARGET_KEYS), "box": pick_box(x)} for x in coerce_items(extract(text))]
    return [x for x in out if x["src"] or x["dst"]]


def reply_items(body: Column) -> Column:
    @F.pandas_udf("array<struct<src:string,dst:string,box:array<double>>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(parse_reply)

    return run(body)


def parse_replies(replies: DataFrame, body: str = "body") -> DataFrame:
    return replies.select(*[c for c in replies.columns if c != body], F.posexplode(reply_items(F.col(body))).alias("item_no", "item")).select("*", "item.*").drop("item")


def typed_items(body: Column) -> Column:
    """Items of well-formed (or merely untidy) replies without leaving the JVM."""
    s = strip_fences(body)
    kind = "struct<items:array<struct<text:string,translation:string,box:array<double>>>>"
    read = lambda c: F.from_json(c, kind)["items"]
    return F.coalesce(read(s), read(repair_json(s)))


def model_text(body: Column) -> Column:
    """The text of a model's reply envelope: all parts of the first candidate, or the first choice's message."""
    kind = "struct<candidates:array<struct<content:struct<parts:array<struct<text:string>>>>>,choices:array<struct<message:struct<content:string>>>,content:array<struct<text:string>>>"
    j = F.from_json(body, kind)
    parts = lambda c: F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda p: p["text"]), ""))
    return F.coalesce(parts(F.get(j["candidates"], 0)["content"]["parts"]), F.get(j["choices"], 0)["message"]["content"], parts(j["content"]))


#: Where an engine's answer may stand in an item; ``text`` is not among them, as it may echo the source.
ANSWER_KEYS = ("translation", "translated", "translationText", "output", "result", "dst", "zh")


def _answers(text: str | None) -> list[tuple[object, str]]:
    """(id or None, answer) of each item of a reply; bare strings have no id."""
    found = extract(text)
    listed = found if isinstance(found, list) else coerce_items(found)
    if isinstance(found, dict):
        named = next((found[k] for k in LIST_KEYS if isinstance(found.get(k), list)), None)
        listed = named if named is not None else listed or ([found] if any(k in found for k in ANSWER_KEYS) else [])
    out = []
    for item in listed:
        if isinstance(item, str):
            out.append((None, item.strip()))
        elif isinstance(item, dict):
            said = next((v.strip() for k in ANSWER_KEYS if isinstance(v := item.get(k), str) and v.strip()), "")
            out.append((item.get("id") if item.get("id") is not None else item.get("index"), said))
    return [(i, s) for i, s in out if s]


def answers_of(text: str | None, n: int) -> list[str | None]:
    """A reply's answers in the order of the ``n`` texts asked: first by unused valid id, the rest fill the gaps in order."""
    slots, rest = [None] * n, []
    for i, said in _answers(text):
        try:
            at = float(i) if i is not None else None
        except (TypeError, ValueError):
            at = None
        if at is not None and at == int(at) and 0 <= at < n and slots[int(at)] is None:
            slots[int(at)] = said
        else:
            rest.append(said)
    left = iter(rest)
    return [s if s is not None else next(left, None) for s in slots]


def single_answer(text: str | None) -> str:
    """A reply to one text: its first answer, or the bare reply without wrapping quotes."""
    s = (text or "").strip()
    return next((said for _, said in _answers(s)), re.sub("^[\"'“”]+|[\"'“”]+$", "", s).strip())


def batch_answers(replies: DataFrame, body: str = "body", size: str = "n") -> DataFrame:
    """One row for each text of a batch: ``slot`` from 0 and ``answer``, null where the reply has none."""

    @F.pandas_udf("array<string>")
    def run(b: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([answers_of(t, int(k)) for t, k in zip(b, n, strict=True)])

    return replies.select(*[c for c in replies.columns if c not in (body, size)], F.posexplode(run(F.col(body), F.col(size))).alias("slot", "answer"))
