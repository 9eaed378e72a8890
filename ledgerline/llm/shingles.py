"""Hashed word shingles of whole texts, vectorised over a batch of texts.

A batch is one byte buffer. Word hashes come from one running sum of byte times
power of an odd base (differences times the inverse power do not depend on the
place), shingles from sums of five neighbouring word hashes. 64-bit hashes
stand for words and shingles everywhere.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np

WIDTH = 5
# Bytes hashed at a time: the tables of powers and each array of a segment stay at a few megabytes.
_SEGMENT = 1 << 18
_BASE = 0x9E3779B97F4A7C15
_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_WEIGHTS = np.array([pow(0xD6E8FEB86659FD93, k + 1, 1 << 64) for k in range(WIDTH)], np.uint64)
_LENGTH = np.uint64(0xA0761D6478BD642F)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit value."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def table(base: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    return table(_BASE), table(pow(_BASE, -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of its text) of every word, A-Z lower-cased, in order."""
    buffer = b" ".join(texts).lower()  # bytes.lower() changes A-Z only
    data = np.frombuffer(buffer, np.uint8)
    hashes, places, at = [], [], 0
    while at < len(buffer):
        end = len(buffer)
        if end - at > _SEGMENT:
            cut = _SPACE.search(buffer, at + _SEGMENT)
            end = cut.start() if cut else end
        part = data[at:end]
        inside = np.zeros(len(part) + 2, np.int8)
        inside[1:-1] = ~_SPACES[part]
        step = np.diff(inside)
        first, last = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        power, inverse = _powers(max(_SEGMENT * 2, 1 << len(part).bit_length()))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * power[: len(part)], out=sums[1:])
        hashes.append(mix((sums[last] - sums[first]) * inverse[first] ^ (last - first).astype(np.uint64) * _LENGTH))
        places.append(first + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    starts = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
    return np.concatenate(hashes), np.searchsorted(starts, np.concatenate(places), side="right") - 1


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text.

    Fewer than five words make one shingle of the whole sequence (told apart by
    its length); no words make an empty set.
    """
    return grouped_sets(*word_hashes(texts), len(texts))


def grouped_sets(words: np.ndarray, group: np.ndarray, n: int) -> list[np.ndarray]:
    """The same from word hashes and the (ascending) group each word belongs to."""
    bounds = np.searchsorted(group, np.arange(n + 1))
    roll = rolled(words)
    out = []
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b - a >= WIDTH:
            own = np.sort(roll[a : b - WIDTH + 1])
            keep = np.ones(len(own), bool)
            np.not_equal(own[1:], own[:-1], out=keep[1:])
            out.append(own[keep])
        elif b > a:
            out.append(whole(words[a:b]))
        else:
            out.append(roll[:0])
    return out


def rolled(words: np.ndarray) -> np.ndarray:
    """Hash of the five words from each word on, while there are five."""
    n = len(words) - WIDTH + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    out = words[:n] * _WEIGHTS[0]
    for k in range(1, WIDTH):
        out = out + words[k : n + k] * _WEIGHTS[k]
    return mix(out)


def whole(words: np.ndarray) -> np.ndarray:
    """The one shingle of fewer than five words."""
    return mix((words * _WEIGHTS[: len(words)]).sum(keepdims=True) + _of_length(len(words)))


def _of_length(n: int) -> np.ndarray:
    return np.array([n], np.uint64) * _LENGTH


def set_id(own: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    return int(mix(mix(own).sum(keepdims=True) + _of_length(len(own))).view(np.int64)[0])


class Bands:
    """MinHash bands: two sets with Jaccard j share a key with probability 1 - (1 - j**rows)**bands."""

    def __init__(self, bands: int, rows: int, seed: int = 20):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.factor = (rng.integers(0, 1 << 31, (bands * rows, 1), dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
        self.shift = rng.integers(0, 1 << 32, (bands * rows, 1), dtype=np.uint32)
        self.weight = rng.integers(1, 1 << 63, rows, dtype=np.uint64) | np.uint64(1)
        self.salt = rng.integers(1, 1 << 63, bands, dtype=np.uint64)

    def keys(self, own: np.ndarray) -> np.ndarray:
        """One signed 64-bit key a band; the set must not be empty."""
        x = (own >> np.uint64(32)).astype(np.uint32)
        least = np.full(self.bands * self.rows, 0xFFFFFFFF, np.uint32)
        for s in range(0, len(x), 2048):
            np.minimum(least, (self.factor * x[s : s + 2048] + self.shift).min(axis=1), out=least)
        rows = least.reshape(self.bands, self.rows).astype(np.uint64) * self.weight
        return mix(rows.sum(axis=1) + self.salt).view(np.int64)


def bitmap(own: np.ndarray, per: int = 8) -> bytes:
    """Signature of at least `per` bits a member, a power of two long; folding halves gives the shorter ones."""
    n = max(64, 1 << int(per * len(own) - 1).bit_length())
    bits = np.zeros(n, np.uint8)
    bits[own & np.uint64(n - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def narrow(own: np.ndarray) -> np.ndarray:
    """The same as four signed 64-bit words: small enough to travel with every candidate."""
    bits = np.zeros(256, np.uint8)
    bits[own & np.uint64(255)] = 1
    return np.packbits(bits, bitorder="little").view(np.int64)


def fold(signature: np.ndarray, length: int) -> np.ndarray:
    """A signature as bytes, or-folded to `length` bytes."""
    while len(signature) > length:
        half = len(signature) // 2
        signature = signature[:half] | signature[half:]
    return signature


def overlap_bound(n_a: np.ndarray, n_b: np.ndarray, only_a: np.ndarray, only_b: np.ndarray) -> np.ndarray:
    """Most members two sets can share, given how many bits are set in one signature only."""
    return np.minimum(n_a - only_a, n_b - only_b)


def links(n_a, n_b, shared, percent: int):
    """100 * shared >= percent * union, in whole numbers."""
    return 100 * shared >= percent * (n_a + n_b - shared)


def shared_count(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
