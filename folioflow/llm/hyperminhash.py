"""HyperMinHash signatures of word-shingle sets: registers, bands, and a collision-corrected estimate."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

#: Registers of a signature, bands of ROWS registers at the lowest threshold in use, and the mantissa bits that a register keeps.
REGISTERS, ROWS, BANDS, MANTISSA = 252, 5, 50, 10
#: Chance at which a pair at the threshold itself may share no band.
MISS = 1e-8
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
_BAND = np.random.default_rng(20).integers(0, 2**63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rows_for(threshold: float) -> int:
    """The most registers a band may have so that a pair at ``threshold`` misses all bands with a chance below ``MISS``.

    Longer bands make fewer chance candidates: 5 registers at 0.80, 6 at 0.85.
    """
    return max((r for r in range(1, 13) if (1 - threshold**r) ** (REGISTERS // r) < MISS), default=1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so equal results mean equal inputs."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_WORDS = Words()


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's ``width``-word shingles.

    bytes.lower() lower-cases A-Z alone and bytes.split() splits at bytes 9 to 13 and 32 alone, as the contract
    says. Fewer words than ``width`` are one shingle; no words are none.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    n = min(width, len(h))
    count = len(h) - n + 1
    total = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        total += mixed(h[k : k + count] + _ODD[k]) * _ODD[(k + 1) % width]
    return np.unique(mixed(total))


def set_key(hashes: np.ndarray) -> tuple[int, int]:
    """A 128-bit digest of a whole set."""
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def registers(hashes: np.ndarray) -> np.ndarray:
    """For each bucket the smallest hash in it, as (leading zeros + 1) and its next ``MANTISSA`` bits; 0 if none fell in.

    The bucket comes from a second hash, so the first one is still uniform inside a bucket. ``hashes`` ascend: written
    backwards, the last write to a bucket is its smallest.
    """
    out = np.zeros(REGISTERS, dtype=np.uint16)
    if len(hashes):
        bucket = ((mixed(hashes ^ _ODD[4]) >> np.uint64(32)) * np.uint64(REGISTERS)) >> np.uint64(32)
        low = np.full(REGISTERS, np.iinfo(np.uint64).max, dtype=np.uint64)
        low[bucket[::-1].astype(np.int64)] = hashes[::-1]
        used = np.zeros(REGISTERS, dtype=bool)
        used[bucket.astype(np.int64)] = True
        zeros = 63 - np.frexp(np.maximum(low, 1).astype(np.float64) * (1 - 2.0**-53))[1].astype(np.int64) + 1
        zeros = np.clip(zeros, 0, 62)
        left = low << (zeros + 1).astype(np.uint64)
        part = (left >> np.uint64(64 - MANTISSA)).astype(np.uint16)
        out[used] = ((zeros[used].astype(np.uint16) + np.uint16(1)) << np.uint16(MANTISSA)) | part[used]
    return out


def band_keys(regs: np.ndarray, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(signatures x bands) 64-bit keys of the bands of ``rows`` registers, and which bands hold anything."""
    bands = REGISTERS // rows
    r = regs[:, : bands * rows].reshape(-1, bands, rows).astype(np.uint64)
    key = mixed((mixed(r + np.uint64(1)) * _BAND[:rows]).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64) * _ODD[0])
    return key.view(np.int64), r.any(axis=2)


def few_keys(regs: np.ndarray, most: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Rows and keys of signatures with at most ``most`` used registers: one of all of them, one of all but each.

    Sets that differ in one shingle always share such a key; in so small sets, one band may hold all of what they share.
    """
    few = np.flatnonzero((regs != 0).sum(axis=1) <= most)
    r, c = np.nonzero(regs[few])
    each = mixed((c.astype(np.uint64) << np.uint64(16)) + regs[few][r, c] + _ODD[3])
    total = np.zeros(len(few), dtype=np.uint64)
    np.add.at(total, r, each)
    rows, keys = np.concatenate([np.arange(len(few)), r]), np.concatenate([total, total[r] - each])
    return few[rows[keys != 0]], mixed(keys[keys != 0]).view(np.int64)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of ``a`` and ``b`` and the number of buckets that each rests on.

    Registers of different minima agree by chance when their zeros and mantissa agree; the expected
    share of such agreements (measured by the mean chance over geometric zero counts) is taken off.
    """
    both = (a != 0) | (b != 0)
    n = np.maximum(both.sum(axis=-1), 1)
    same = ((a == b) & both).sum(axis=-1)
    chance = 2.0**-MANTISSA / 3  # sum over z of 2**-2z is 1/3
    return (same / n - chance) / (1 - chance), n


def possible(est: np.ndarray, n: np.ndarray, threshold: float, deviations: float = 6.0) -> np.ndarray:
    """False only where the true similarity reaches ``threshold`` with a chance of ``deviations`` sigmas."""
    return est >= threshold - deviations * np.sqrt(threshold * (1 - threshold) / n) - 1 / n


def jaccard_counts(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Sizes of the intersection and union of two sorted sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both, len(a) + len(b) - both
