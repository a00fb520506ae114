"""Gap-weighted subsequence kernel of words, in its explicit feature space."""

from __future__ import annotations

import unicodedata

import numpy as np

#: Subsequence length, decay for each spanned character, longest span, letters of the alphabet, longest piece of a word.
P, DECAY, SPAN, LETTERS, LONGEST = 3, 0.6, 7, 48, 24
DIM = LETTERS**P
_GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]


def _code(c: str) -> int:
    """1 to 26 for a to z and their accented forms, 47 for what is no letter; other scripts' letters share 27 to 46 by a hash."""
    base = unicodedata.normalize("NFKD", c)[0].lower()
    if "a" <= base <= "z":
        return ord(base) - 96
    if not c.isalpha():
        return LETTERS - 1
    return 27 + ((ord(c) * 2654435761 & 0xFFFFFFFF) >> 16) % (LETTERS - 28)


class _Codes(dict):
    def __missing__(self, c: str) -> int:
        self[c] = code = _code(c)
        return code


_CODES = _Codes()


def encode(words: list[str]) -> np.ndarray:
    """Letter codes of words, padded with 0 so that a span may run past the end."""
    width = max([P, *map(len, words)]) + SPAN
    out = np.zeros((len(words), width), dtype=np.int32)
    for i, w in enumerate(words):
        out[i, : len(w)] = [_CODES[c] for c in w]
    return out


def occurrences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the features (0 where there is none) and weights of all its subsequences of ``P`` characters.

    A subsequence that spans s characters weighs DECAY ** s; spans above ``SPAN`` weigh under 3 per cent and are left out.
    """
    c = encode(words)
    n = c.shape[1] - SPAN
    parts, weights = [], []
    for a, b in _GAPS:
        x, y, z = c[:, :n], c[:, a : a + n], c[:, a + b : a + b + n]
        parts.append(np.where((x > 0) & (y > 0) & (z > 0), (x * LETTERS + y) * LETTERS + z, 0))
        weights.append(np.where(parts[-1] > 0, np.float32(DECAY ** (a + b + 1)), np.float32(0)))
    return np.concatenate(parts, axis=1), np.concatenate(weights, axis=1)


def self_kernel(feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """K(w, w) of each word: squares of its features' summed weights."""
    order = np.argsort(feature, axis=1, kind="stable")
    f, w = np.take_along_axis(feature, order, 1), np.take_along_axis(weight, order, 1).astype(np.float64)
    rows, cols = f.shape
    start = np.ones((rows, cols), dtype=bool)
    start[:, 1:] = f[:, 1:] != f[:, :-1]
    group = np.cumsum(start.ravel()) - 1
    sums = np.bincount(group, weights=w.ravel())
    owner = np.repeat(np.arange(rows), cols)[start.ravel()]
    return np.bincount(owner, weights=sums * sums, minlength=rows)


def dense(words: list[str]) -> np.ndarray:
    """Unit feature vectors of a few words (the landmarks)."""
    f, w = occurrences(words)
    out = np.zeros((len(words), DIM), dtype=np.float32)
    np.add.at(out, (np.repeat(np.arange(len(words)), f.shape[1]), f.ravel()), w.ravel())
    out[:, 0] = 0
    return out / np.sqrt(np.maximum((out.astype(np.float64) ** 2).sum(axis=1, keepdims=True), 1e-12)).astype(np.float32)


def project(words: list[str], table: np.ndarray, chunk: int = 1024) -> np.ndarray:
    """Normalised kernel of each word with the columns of ``table`` (DIM x m): K(w, column) / sqrt(K(w, w)).

    Words of like length share a chunk, as all in a chunk are as wide as its longest.
    """
    out, chunk = np.zeros((len(words), table.shape[1])), max(32, chunk // max(1, table.shape[1] // 8))
    order = np.argsort([len(w) for w in words], kind="stable")
    for a in range(0, len(words), chunk):
        at = order[a : a + chunk]
        f, w = occurrences([words[i] for i in at])
        norm = np.sqrt(np.maximum(self_kernel(f, w), 1e-12))
        out[at] = np.einsum("wf,wfm->wm", w, table[f]) / norm[:, None]
    return out


def pieces(word: str) -> list[str]:
    """A word, or overlapping pieces that cover the whole of a very long one."""
    if len(word) <= LONGEST:
        return [word]
    step = LONGEST // 2
    return [word[a : a + LONGEST] for a in range(0, len(word) - step, step)]
