"""Page images as baseline JPEG for requests: blocks in NumPy, a Huffman code of each image's own."""

from __future__ import annotations

import struct
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUALITY = 92
#: The standard's example tables of quantisers for brightness and colour.
LUMA = np.array([
    16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62,
    18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99,
]).reshape(8, 8)
CHROMA = np.full((8, 8), 99)
CHROMA[:4, :4] = [[17, 18, 24, 47], [18, 21, 26, 66], [24, 26, 56, 99], [47, 66, 99, 99]]
#: The order of a block's coefficients: along antidiagonals, up and down in turn.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
#: The cosine transform of eight values.
COSINE = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])
#: Rows of pixels that are transformed at once, and the longest code.
STRIPE, LONGEST = 256, 16


def quantisers(quality: int) -> list[np.ndarray]:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((t * scale + 50) // 100, 1, 255) for t in (LUMA, CHROMA)]


def _blocks(rgb: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    """Quantised coefficients (block of 8 x 8 pixels, component, place in the zigzag) of a stripe."""
    h, w = rgb.shape[:2]
    p = np.pad(rgb, ((0, -h % 8), (0, -w % 8), (0, 0)), mode="edge").astype(np.float64)
    r, g, b = p[..., 0], p[..., 1], p[..., 2]
    y = 0.299 * r + 0.587 * g + 0.114 * b
    parts = []
    for plane, table in ((y - 128, tables[0]), ((b - y) / 1.772, tables[1]), ((r - y) / 1.402, tables[1])):
        cut = plane.reshape(p.shape[0] // 8, 8, -1, 8).transpose(0, 2, 1, 3).reshape(-1, 8, 8)
        parts.append(np.rint(COSINE @ cut @ COSINE.T / table).astype(np.int32).reshape(-1, 64)[:, ZIGZAG])
    return np.stack(parts, axis=1)


def _symbols(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """In order: the code table of each symbol (0, 1 for first coefficients, 2, 3 for others), the symbol, its further bits and their number."""
    flat = blocks.reshape(-1, 64)
    colour = (np.arange(len(flat)) % 3 > 0).astype(np.int32)
    first = np.diff(blocks[:, :, 0], axis=0, prepend=0).reshape(-1)
    at, place = np.nonzero(flat[:, 1:])
    place += 1
    value = flat[at, place]
    before = np.concatenate([[0], place[:-1]]) if len(at) else place
    before[np.concatenate([[True], at[1:] != at[:-1]]) if len(at) else []] = 0
    run = place - before - 1
    again = run // 16
    last = np.zeros(len(flat), dtype=np.int64)
    last[at] = place  # the last one stays
    short = np.flatnonzero(last < 63)
    size = lambda v: np.ceil(np.log2(np.abs(v) + 1)).astype(np.int32)
    bits = lambda v, s: np.where(v < 0, v + (1 << s) - 1, v)
    s0, s1 = size(first), size(value)
    far = np.repeat(np.arange(len(at)), again)
    zero = lambda n: np.zeros(n, dtype=np.int32)
    key = np.concatenate([np.arange(len(flat)) * 66, at[far] * 66 + place[far], at * 66 + place, short * 66 + 65])
    order = np.argsort(key, kind="stable")
    table = np.concatenate([colour, 2 + colour[at[far]], 2 + colour[at], 2 + colour[short]])
    symbol = np.concatenate([s0, zero(len(far)) + 0xF0, (run % 16) * 16 + s1, zero(len(short))])
    more = np.concatenate([bits(first, s0), zero(len(far)), bits(value, s1), zero(len(short))])
    count = np.concatenate([s0, zero(len(far)), s1, zero(len(short))])
    return table[order], symbol[order], more[order], count[order]


def code_lengths(weights: dict[int, int], longest: int = LONGEST) -> dict[int, int]:
    """Lengths of the best prefix code of at most ``longest`` bits (packages merged from the lightest up), for two symbols at least."""
    leaves = sorted((w, (s,)) for s, w in weights.items())
    level: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(longest):
        level = sorted(leaves + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2])], key=lambda p: p[0])
    return Counter(s for _, held in level[: 2 * len(leaves) - 2] for s in held)


def _code(symbols: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A table as the file holds it, and code and length by symbol. A symbol that is never used takes the code of ones alone."""
    found, n = np.unique(symbols, return_counts=True)
    lengths = code_lengths({int(s): int(c) for s, c in zip(found, n)} | {256: 0})
    ranked = sorted(lengths, key=lambda s: (lengths[s], s))
    code, length, value, before = np.zeros(257, dtype=np.int64), np.zeros(257, dtype=np.int64), 0, 0
    for s in ranked:
        value <<= lengths[s] - before
        code[s], length[s], before = value, lengths[s], lengths[s]
        value += 1
    used = [s for s in ranked if s != 256]
    per = Counter(lengths[s] for s in used)
    return bytes(per[k] for k in range(1, 17)) + bytes(used), code, length


def encode_jpeg(rgb: np.ndarray, quality: int = QUALITY) -> bytes:
    """An image (height, width, 3) of at most 65,535 pixels a side as JPEG, all colours at full resolution."""
    h, w = rgb.shape[:2]
    if not (0 < h < 65_536 and 0 < w < 65_536):
        raise ValueError(f"no JPEG can have {w} x {h} pixels")
    tables = quantisers(quality)
    blocks = np.concatenate([_blocks(rgb[y : y + STRIPE], tables) for y in range(0, h, STRIPE)])
    table, symbol, more, count = _symbols(blocks)
    codes = [_code(symbol[table == k]) for k in range(4)]
    code, length = (np.stack([c[i] for c in codes])[table, symbol] for i in (1, 2))
    value, total = (code << count) | more, length + count
    packed, left = [], np.zeros(0, dtype=np.uint8)
    for i in range(0, len(value), 1 << 18):
        v, n = value[i : i + (1 << 18), None], total[i : i + (1 << 18), None]
        k = np.arange(27)
        bits = np.concatenate([left, ((v >> np.maximum(n - 1 - k, 0)) & 1).astype(np.uint8)[k < n]])
        whole = len(bits) // 8 * 8
        packed.append(np.packbits(bits[:whole]).tobytes())
        left = bits[whole:]
    if len(left):
        packed.append(np.packbits(np.concatenate([left, np.ones(8 - len(left), dtype=np.uint8)])).tobytes())
    part = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return b"".join([
        b"\xff\xd8", part(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0"),
        *[part(0xDB, bytes([i, *t.reshape(-1)[ZIGZAG].tolist()])) for i, t in enumerate(tables)],
        part(0xC0, struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x11, 0, 2, 0x11, 1, 3, 0x11, 1])),
        *[part(0xC4, bytes([kind]) + codes[k][0]) for k, kind in enumerate((0x00, 0x01, 0x10, 0x11))],
        part(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])), b"".join(packed).replace(b"\xff", b"\xff\0"), b"\xff\xd9",
    ])


def jpeg_pages(pages: DataFrame, quality: int = QUALITY) -> DataFrame:
    """``pages`` (width, height, rgb binary and any other columns) with ``jpeg`` in place of ``rgb``; no image has no JPEG."""
    rest = [c for c in pages.columns if c.lower() not in ("rgb", "jpeg")]
    wide = pages.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("width").cast("int").alias("w"), F.col("height").cast("int").alias("h"), "rgb")
    schema = wide.select("row", F.lit(None).cast("binary").alias("jpeg")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [encode_jpeg(np.frombuffer(x.as_buffer(), dtype=np.uint8).reshape(h.as_py(), w.as_py(), 3), quality) if x.is_valid else None for w, h, x in zip(b["w"], b["h"], b["rgb"], strict=True)]
            yield pa.RecordBatch.from_arrays([b["row"], pa.array(made, pa.binary())], names=["row", "jpeg"])

    return wide.mapInArrow(run, schema).select("row.*", "jpeg")


def request_body(protocol: str, prompt: Column, jpeg: Column, system: str = "", model: str = "") -> Column:
    """A request's JSON: of the protocol whose images are parts (``gemini``), else of chat completions with an image by address."""
    data = F.regexp_replace(F.base64(jpeg), r"\s", "")  # some versions break lines
    if protocol == "gemini":
        text, image = F.struct(prompt.alias("text")), F.struct(F.struct(F.lit("image/jpeg").alias("mime_type"), data.alias("data")).alias("inline_data"))
        parts = F.concat(F.lit('{"contents":[{"parts":['), F.to_json(text), F.lit(","), F.to_json(image), F.lit("]}],"))
        return F.concat(parts, F.lit('"generationConfig":{"temperature":0,"responseMimeType":"application/json"}}'))
    text = F.struct(F.lit("text").alias("type"), prompt.alias("text"))
    image = F.struct(F.lit("image_url").alias("type"), F.struct(F.concat(F.lit("data:image/jpeg;base64,"), data).alias("url")).alias("image_url"))
    told = F.to_json(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    head = F.to_json(F.struct(F.lit(model).alias("model"), F.lit(0).alias("temperature")))
    return F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"messages":['), told, F.lit(',{"role":"user","content":['), F.to_json(text), F.lit(","), F.to_json(image), F.lit("]}]}"))
