"""Packing token pieces into fixed-length sequences: first-fit decreasing over a tournament tree."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import small_batches, text_of, written

#: Pieces that one task packs at a time.
GROUP = 8192
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


#: Texts of these characters alone are split here; any other text goes to the tokenizer whole.
_LETTERS = "a-z\u00df-\u00f6\u00f8-\u00fe\u0153"
_PLAIN = re.compile("[ \\t\\n\\r\\x21-\\x7e\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00fe\u0152\u0153\u2013\u2014\u2018-\u201f\u2026\u20ac]*")
_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^ \\t\\n\\r0-9{_LETTERS}]+")


def _byte_letters() -> dict[int, str]:
    """The visible letter that byte-level vocabularies write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: What a tokenizer file says that normalises and splits as _WORD and lower() do.
_NORMALISER = {"NFC", "Lowercase", "Replace \\s+"}
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_in_words(tokenizer) -> bool:
    """Whether a loaded tokenizer's own description is that of the word vocabularies that ``WordEncoder`` splits for."""
    said = json.loads(tokenizer.to_str())
    norm, pre = said.get("normalizer") or {}, said.get("pre_tokenizer") or {}
    steps = {f"{n['type']} {n['pattern'].get('Regex')}" if n["type"] == "Replace" else n["type"] for n in norm.get("normalizers", [])}
    split = [p.get("pattern", {}).get("Regex") for p in pre.get("pretokenizers", []) if p["type"] == "Split"]
    model = said.get("model") or {}
    return steps == _NORMALISER and split == [_SPLIT] and model.get("type") == "BPE" and not model.get("byte_fallback")


class WordEncoder:
    """Token ids of whole texts, each distinct word put through the tokenizer's model once.

    Holds for lower-casing word BPE vocabularies that split at white space, letters, single digits and
    the rest, which the loaded file must say itself (``splits_in_words``); any other tokenizer encodes every text whole. Words are remembered in two generations of about ``most``: a full one becomes the older, whose words
    come back as they recur, each as its ids' bytes, and are otherwise forgotten with it; a text with any character outside the plain set, or with the mark of a
    special token, is encoded whole by the tokenizer. The tests hold both ways against it.
    """

    def __init__(self, path: str, most: int = 100_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # the pipeline around it is what _WORD and lower() stand for
        self.by_word = splits_in_words(self.tokenizer)
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.most = most

    def _learn(self, words: list[str]) -> None:
        known, older, letters, model = self.known, self.older, self.letters, self.model
        for w in words:
            if w not in known:
                ids = older.get(w)
                if ids is None:
                    shown = w if w.isascii() else "".join([letters[b] for b in w.encode()])
                    ids = b"".join([t.id.to_bytes(4, "little") for t in model.tokenize(shown)])
                known[w] = ids

    def ids(self, text: str) -> np.ndarray:
        if not self.by_word or "<|" in text or not _PLAIN.fullmatch(text):
            return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        words = _WORD.findall(text.lower())
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        try:
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u4")
        except KeyError:
            self._learn(words)
            return np.frombuffer(b"".join(map(self.known.__getitem__, words)), dtype="<u4")


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker, so that its tasks share what it remembers."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def cut_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 4096, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Documents as token pieces of at most ``length`` ids; the last id of a document is ``end_id``.

    With ``with_ids`` the ids themselves come along as ``ids``, little-endian unsigned 32-bit numbers.
    """
    small_batches(docs.sparkSession)
    schema = PIECES + (", ids binary" if with_ids else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer).ids
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text), np.uint32(end_id)).astype("<u4")
                for start in range(0, len(ids), length):
                    raw = ids[start : start + length].tobytes()
                    rows.append((doc_id, start, len(raw) // 4, zlib.crc32(raw), len(ids), *([raw] if with_ids else [])))
                    held += len(raw)
                if with_ids and held > 8 << 20:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    nullable = slim.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
    return nullable.mapInPandas(_with_int_ids(cut), schema)


def _with_int_ids(cut):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return cut(b.assign(doc_id=[None if x is None else int(x) for x in b["doc_id"]]) for b in batches)

    return run


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each item, longest first into the first bin with room.

    A tournament tree holds in each node the most room below it, so the first bin with room is found
    from the root in log n steps.
    """
    leaves = 1
    while leaves < max(1, len(lengths)):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, at = lengths[i], 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
    return bins, offsets


def pack_pieces(pieces: DataFrame, length: int = 4096, seed: int = 11, group: int = GROUP) -> DataFrame:
    """``pieces`` (a written table) with ``sequence_id`` and ``offset``; offsets in a sequence are gapless from 0.

    Pieces are dealt by a seeded hash into randomised groups of about ``group``, each packed on its
    own; a sequence id is the group's number and the bin in it. Only the pieces' numbers go through
    this exchange, and a document's pieces go to different groups, so a very long document is no single task. The hash takes in
    where the written table holds a piece, so that repeated rows (a third of all may be one) are dealt out like any others.
    """
    groups = max(1, -(-pieces.count() // group))
    dealt = pieces.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed)), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id long, offset long"

    def pack(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(part["length"].tolist(), length)
        return part.drop(columns="group").assign(sequence_id=(int(key[0]) << 32) + np.array(bins, dtype="int64"), offset=offsets).astype({"doc_id": "Int64"})

    return dealt.groupBy("group").applyInPandas(pack, schema)


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 4096, end_id: int = 2, with_ids: bool = False, **names) -> DataFrame:
    """Pack whole documents into sequences of at most ``length`` tokens, one row per piece.

    Defined cases: a null or empty text is the single id ``end_id``; null ids stay null; repeated rows
    are packed as often as they occur; very long texts become many full pieces; other columns are not carried, so clashing names do no
    harm; an empty table gives an empty result.
    """
    return pack_pieces(written(cut_pieces(docs, tokenizer, length=length, end_id=end_id, with_ids=with_ids, **names), "pieces"), length)


def sequences(packed: DataFrame, length: int = 4096, pad_id: int = 0) -> DataFrame:
    """``sequence_id`` and ``ids`` (packed with ``with_ids``) of each sequence, padded to ``length`` unless it holds a power of two."""

    def join(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        ids = np.frombuffer(b"".join(part.sort_values("offset")["ids"]), dtype="<u4")
        full = len(ids) if len(ids) & (len(ids) - 1) == 0 else length
        return pd.DataFrame({"sequence_id": [key[0]], "ids": [np.pad(ids, (0, full - len(ids)), constant_values=pad_id).astype("int64")], "tokens": [len(ids)]})

    return packed.groupBy("sequence_id").applyInPandas(join, "sequence_id long, ids array<long>, tokens long")
