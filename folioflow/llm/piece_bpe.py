"""Encoding and decoding with merge-type piece vocabularies: a score-ordered agenda of adjacent symbol pairs."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from ._common import row_slices, text_of, without

ADDED = ("ids", "decoded", "agrees")
#: The vocabulary's sign for a blank.
MARK = "▁"
#: Chunks remembered in one generation of a worker's memory, and the longest that is remembered.
MOST, LONGEST = 450_000, 48
#: Symbols for which a list is the faster agenda, and what stands there for a pair that is no piece.
FEW, NEVER = 32, float("inf")
#: New chunks from which agendas side by side are faster, the most at once, and the rank of a pair that is no piece.
MANY, AT_ONCE, LAST = 64, 20_000, np.iinfo("i4").max
#: Bytes of texts that are encoded at once: their chunks are Python strings.
SLICE = 1 << 20
#: Fixed values of the model file: field numbers, the number of the merge type, the kinds of pieces.
PIECES, TRAINER, NORMALIZER, MODEL_TYPE, CHARSMAP, DUMMY_PREFIX, EXTRA_BLANKS = 1, 2, 3, 3, 2, 3, 4
MERGES, NORMAL, UNKNOWN, CONTROL, BYTE = 2, 1, 2, 3, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one message of a model file."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


class Pairs:
    """Which piece two adjacent pieces make, and its rank by score, for arrays of pairs: a hash table in arrays, at most half full."""

    def __init__(self, number: dict[str, bytes], score: dict[str, float]):
        ids = {text: int.from_bytes(i, "little") for text, i in number.items()}
        ranks = dict(zip(ids, np.unique([score[text] for text in ids], return_inverse=True)[1].tolist()))
        self.base = max(ids.values(), default=0) + 1
        found = [(ids[a] * self.base + ids[b], ids[text], ranks[text]) for text in ids for k in range(1, len(text)) if (a := text[:k]) in ids and (b := text[k:]) in ids]
        keys, made, rank = (np.array(x, dtype="i8") for x in zip(*found)) if found else np.empty((3, 0), "i8")
        bits = max(8, (2 * len(keys)).bit_length())
        self.mask, self.shift = (1 << bits) - 1, np.uint64(64 - bits)
        self.key = np.full(1 << bits, -1, "i8")
        left, at = np.arange(len(keys)), self._home(keys)
        while left.size:  # each takes the first free place from its home on; of several for one place, one
            free = left[self.key[at[left]] < 0]
            self.key[at[free]] = keys[free]
            left = left[self.key[at[left]] != keys[left]]
            at[left] = at[left] + 1 & self.mask
        self.made, self.rank = np.full(1 << bits, -1, "i4"), np.full(1 << bits, LAST, "i4")
        self.made[at], self.rank[at] = made, rank
        characters = {ord(text): i for text, i in ids.items() if len(text) == 1}
        #: Ids by code point, -1 for what is no piece; the last place stands for all that lie behind.
        self.character = np.full(max(characters, default=0) + 2, -1, "i4")
        self.character[list(characters)] = list(characters.values())

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view("u8") * np.uint64(0x9E3779B97F4A7C15) >> self.shift).view("i8")

    def places(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the pairs stand in ``made`` and ``rank``; a free place says that a pair is no piece."""
        keys = a * np.int64(self.base) + b
        at = self._home(keys)
        other = np.flatnonzero(self.key[at] != keys)
        while other.size:
            other = other[self.key[at[other]] >= 0]
            at[other] = at[other] + 1 & self.mask
            other = other[self.key[at[other]] != keys[other]]
        return at

    def ranks(self, symbol: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The ranks of the pairs that begin at ``at``; the last symbol of a row begins none."""
        after = np.minimum(at + 1, len(row) - 1)
        found = self.rank[self.places(symbol[at], symbol[after])]
        found[(after == at) | (row[after] != row[at])] = LAST
        return found


class Agenda:
    """Ids of whole texts under one vocabulary, and texts of ids.

    Inside, a blank stands for the vocabulary's mark, and a mark in a text is a blank to the vocabulary too. A text is cut where no
    merge can ever reach, because no piece of several characters holds what stands on both sides: a blank after another
    character, a character outside ``joining``, a sign after a letter. So the agenda of each chunk pops its pairs in the order in
    which one agenda of the whole text would, and a chunk that recurs need not be merged again. Chunks are remembered in two
    generations of about ``MOST``; those longer than ``LONGEST`` never. The agendas of many new chunks run side by side.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        parts: dict[int, list] = {}
        for number, value in _fields(self.library.serialized_model_proto()):
            parts.setdefault(number, []).append(value)
        norm = dict(_fields(parts[NORMALIZER][0])) if NORMALIZER in parts else {}
        kinds = set()
        self.score: dict[str, float] = {}
        self.number: dict[str, bytes] = {}
        self.shown: list[bytes] = []
        self.byte: dict[int, bytes] = {}
        for i, piece in enumerate(parts[PIECES]):
            said = dict(_fields(piece))
            text, kind = said[1].decode().replace(MARK, " "), said.get(3, NORMAL)
            kinds.add(kind)
            self.shown.append(text.encode())
            if kind == NORMAL:
                self.number[text], self.score[text] = i.to_bytes(4, "little"), -struct.unpack("<f", said.get(2, bytes(4)))[0]
            elif kind == BYTE:
                self.byte[int(text[1:-1], 16)] = i.to_bytes(4, "little")
                self.shown[i] = bytes([int(text[1:-1], 16)])
        if dict(_fields(parts[TRAINER][0])).get(MODEL_TYPE, 1) != MERGES or kinds - {NORMAL, UNKNOWN, CONTROL, BYTE} or len(self.byte) != 256:
            raise ValueError(f"{path} is no merge-type vocabulary of normal, control and all byte pieces")
        self.prefix = bool(norm.get(DUMMY_PREFIX, 1))
        self.plain = not norm.get(CHARSMAP) and not norm.get(EXTRA_BLANKS, 1)
        self.chunks = self._cuts([p for p in self.number if len(p) > 1])
        self.pairs = Pairs(self.number, self.score)
        self.texts = pa.array(self.shown, pa.large_binary())
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _cuts(pieces: list[str]) -> re.Pattern:
        """The pattern of chunks, from what stands side by side in pieces of several characters."""
        joining = {c for p in pieces for c in p} - {" "}
        letters = {c for c in joining if c.isalpha()}
        signs = joining - letters - {b for p in pieces for a, b in zip(p, p[1:]) if a in letters}
        known, word, sign, other = ("".join(map(re.escape, sorted(x))) for x in (joining, letters, signs, joining - letters - signs))
        if any(" " in p.lstrip(" ") for p in pieces):
            return re.compile(f"[ {known}]+|[^ {known}]", re.S)
        more = f"(?:[{other}][{known}]*+)?+" if other else ""  # letters end before a sign; before another character they do not
        cut = f" *+[{word}]++{more}|" if word and sign else ""
        return re.compile(f"{cut} *[{known}]+| +|[^ {known}]", re.S)

    def normalised(self, text: str) -> str:
        if not self.plain:
            return self.library.normalize(text).replace(MARK, " ")
        marked = text.replace(MARK, " ")
        return " " + marked if self.prefix and marked else marked

    def merged(self, chunk: str) -> list[str]:
        """The symbols that are left when the agenda is empty: best score first, then leftmost."""
        return self._few(chunk) if len(chunk) <= FEW else self._many(chunk)

    def _few(self, chunk: str) -> list[str]:
        """A list by place is agenda enough for few symbols: the first of the best scores is taken off."""
        score, symbol = self.score.get, list(chunk)
        agenda = [score(a + b, NEVER) for a, b in zip(chunk, chunk[1:])]
        while agenda:
            best = min(agenda)
            if best == NEVER:
                break
            i = agenda.index(best)
            symbol[i] = made = symbol[i] + symbol[i + 1]
            del symbol[i + 1], agenda[i]
            if i:
                agenda[i - 1] = score(symbol[i - 1] + made, NEVER)
            if i < len(agenda):
                agenda[i] = score(made + symbol[i + 1], NEVER)
        return symbol

    def _many(self, chunk: str) -> list[str]:
        """A heap for many: pairs whose symbols have changed since they were put in are passed over."""
        score, symbol, last = self.score.get, list(chunk), len(chunk) - 1
        after, before = list(range(1, last + 2)), list(range(-1, last))
        agenda = [(s, i, i + 1, 2) for i, pair in enumerate(map("".join, zip(chunk, chunk[1:]))) if (s := score(pair)) is not None]
        heapify(agenda)
        while agenda:
            _, left, right, size = heappop(agenda)
            a, b = symbol[left], symbol[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            a += b
            symbol[left], symbol[right] = a, ""
            right = after[left] = after[right]
            if right <= last:
                before[right] = left
                s = score(a + symbol[right])
                if s is not None:
                    heappush(agenda, (s, left, right, size + len(symbol[right])))
            right, left = left, before[left]
            if left >= 0:
                s = score(symbol[left] + a)
                if s is not None:
                    heappush(agenda, (s, left, right, size + len(symbol[left])))
        return [s for s in symbol if s]

    def side_by_side(self, chunks: list[str]) -> list[bytes | None]:
        """The ids of each chunk as bytes, None for one with a character that is no piece.

        All symbols stand in one array, a row a chunk. In each round every chunk takes the first of the best pairs off its agenda,
        and those without a pair leave.
        """
        pairs = self.pairs
        codes = np.frombuffer("".join(chunks).encode("utf-32-le"), "<u4")
        symbol = pairs.character[np.minimum(codes, len(pairs.character) - 1)]
        row = np.repeat(np.arange(len(chunks), dtype="i4"), list(map(len, chunks)))
        strange = np.zeros(len(chunks), bool)
        strange[row[symbol < 0]] = True
        kept = ~strange[row]
        row, symbol = row[kept], symbol[kept]
        rank = pairs.ranks(symbol, row, np.arange(len(row)))
        rows, symbols = [row[:0]], [symbol[:0]]
        while row.size:
            first = np.flatnonzero(np.diff(row, prepend=-1))
            best, size = np.minimum.reduceat(rank, first), np.diff(first, append=len(row))
            going = best < LAST
            live = np.repeat(going, size)
            rows.append(row[~live])
            symbols.append(symbol[~live])
            row, symbol, rank = row[live], symbol[live], rank[live]
            at = np.flatnonzero(rank == np.repeat(best[going], size[going]))
            at = at[np.diff(row[at], prepend=-1) != 0]
            symbol[at] = pairs.made[pairs.places(symbol[at], symbol[at + 1])]
            kept = np.ones(len(row), bool)
            kept[at + 1] = False
            row, symbol, rank = row[kept], symbol[kept], rank[kept]
            at -= np.arange(len(at))
            at = np.concatenate([at[at > 0] - 1, at])
            rank[at] = pairs.ranks(symbol, row, at)
        row = np.concatenate(rows)
        raw = np.concatenate(symbols)[np.argsort(row, kind="stable")].astype("<i4").tobytes()
        ends = np.cumsum(4 * np.bincount(row, minlength=len(chunks))).tolist()
        return [None if odd else raw[a:b] for odd, a, b in zip(strange.tolist(), [0, *ends], ends)]

    def _alone(self, chunk: str) -> bytes:
        """The ids of a chunk, little-endian; symbols that are no piece become their bytes."""
        symbols = self.merged(chunk)
        try:
            return b"".join(map(self.number.__getitem__, symbols))
        except KeyError:
            return b"".join([self.number[s] if s in self.number else b"".join([self.byte[b] for b in s.encode()]) for s in symbols])

    def _learn(self, chunks: set[str]) -> dict[str, bytes]:
        """Put chunks into the younger memory; the ids of those too long for it are returned."""
        known = self.known
        known |= {c: f for c in chunks if (f := self.older.get(c)) is not None}
        new = [c for c in chunks if len(c) <= LONGEST and c not in known]
        for some in (new[i : i + AT_ONCE] for i in range(0, len(new) if len(new) >= MANY else 0, AT_ONCE)):
            known |= {c: f for c, f in zip(some, self.side_by_side(some), strict=True) if f is not None}
        known |= {c: self._alone(c) for c in new if c not in known}
        return {c: self._alone(c) for c in chunks if len(c) > LONGEST}

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        if len(self.known) > MOST:
            self.older, self.known = self.known, {}
        known, cut = self.known.get, [self.chunks.findall(self.normalised(t)) for t in texts]
        found = [list(map(known, chunks)) for chunks in cut]
        long = self._learn({c for chunks, ids in zip(cut, found, strict=True) for c, f in zip(chunks, ids, strict=True) if f is None})
        raw = (b"".join([f or known(c) or long[c] for c, f in zip(chunks, ids, strict=True)]) for chunks, ids in zip(cut, found, strict=True))
        return [np.frombuffer(r, dtype="<i4") for r in raw]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode_all(self, ids: list[np.ndarray]) -> list[str]:
        """The text of each array of ids: bytes joined to characters, without the blank that encoding put before it."""
        taken = self.texts.take(pa.array(np.concatenate(ids), pa.int32()))
        ends = np.cumsum([0, *map(len, ids)])
        _, places, data = taken.buffers()
        places = np.frombuffer(places, "i8", len(taken) + 1)[ends].tolist() if len(taken) else [0] * len(ends)
        raw = memoryview(data or b"")
        return [str(raw[a + (self.prefix and a < b and raw[a] == 32) : b], "utf-8", "replace") for a, b in zip(places, places[1:])]

    def decode(self, ids: list[int]) -> str:
        return self.decode_all([np.array(ids, dtype="i4")])[0]


_AGENDAS: dict[str, Agenda] = {}


def agenda(path: str) -> Agenda:
    """One vocabulary for each Python worker."""
    if path not in _AGENDAS:
        _AGENDAS[path] = Agenda(path)
    return _AGENDAS[path]


def encode_pieces(docs: DataFrame, model: str, text_col: str = "text") -> DataFrame:
    """``docs`` with ``ids`` (array of int), ``decoded`` (the text of these ids) and ``agrees``.

    Each whole text is normalised as the vocabulary says, cut into symbols of one character, and merged through the agenda;
    symbols that are no piece become their bytes. No ids for begin or end, no sampling. In each Arrow batch the library
    encodes and decodes the same texts, and ``agrees`` says whether it came to the same ids and text; where it did not, its
    answer stands in the row.

    Defined cases: a null or empty text has no ids and decodes to the empty text; very long texts are encoded whole, many of
    them in slices of some megabytes; repeated rows are encoded as often as they occur; all other columns pass through, null
    ids too, but for those named like an added one (in any case), which are replaced. An empty table gives an empty result.
    """
    carried = without(docs, *ADDED)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in carried.columns]).alias("row"), text_of(F.col(f"`{text_col}`")).alias("text"))
    schema = StructType([rows.schema["row"], StructField("ids", ArrayType(IntegerType(), False)), StructField("decoded", StringType()), StructField("agrees", BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = agenda(model)
        for part in row_slices(batches, "text", SLICE):
            texts = part.column("text").to_pylist()
            theirs = own.library.encode(texts, num_threads=1, return_type="numpy")
            decoded = own.library.decode(theirs, num_threads=1)
            mine = own.encode_all(texts)
            same = [np.array_equal(m, t) for m, t in zip(mine, theirs, strict=True)]
            ids = [m if s else t for m, t, s in zip(mine, theirs, same, strict=True)]
            agrees = [s and said == back for s, said, back in zip(same, own.decode_all(theirs), decoded, strict=True)]
            flat = pa.array(np.concatenate(ids), type=pa.int32())
            ends = np.cumsum([0, *map(len, ids)], dtype="i4")
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=["row", *ADDED])

    return rows.mapInArrow(run, schema).select("row.*", *ADDED)
