"""Sets of word shingles and their MinHash signatures, in numpy over whole texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import xxhash

from tesserae.llm.common import KEPT_TABLES

_RANDOM = np.random.default_rng(97)
BYTE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
PLACE = _RANDOM.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_POWERS: dict[int, np.ndarray] = {}
KEPT_TABLES.append(_POWERS)


def powers(base: int, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 21)
        step = np.full(size, base, np.uint64)
        step[0] = 1
        held = _POWERS[base] = np.cumprod(step)
    return held[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word `[^\\x20\\x09-\\x0D]+`, with the index of its text; A-Z count as a-z."""
    data = np.frombuffer(b" ".join(texts).lower() + b" ", np.uint8)
    gap = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], gap]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE[data] * powers(BASE, len(data)))])
    back = powers(pow(BASE, -1, 2**64), len(data))
    h = (sums[ends] - sums[starts]) * back[starts]
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    return mix(h ^ (ends - starts).astype(np.uint64) * PLACE[-1]), np.searchsorted(offsets, starts, "right") - 1


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text, in order; fewer words than `width` are one shingle."""
    words, owner = word_hashes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(counts)])
    n = max(len(words) - width + 1, 0)
    h = np.zeros(n, np.uint64)
    for j in range(width):
        h += words[j : n + j] * PLACE[j]
    h = mix(h)
    for i, count in enumerate(counts):
        a = first[i]
        if count >= width:
            yield np.unique(h[a : a + count - width + 1])
        elif count:
            short = (words[a : a + count] * PLACE[:count]).sum(dtype=np.uint64)
            yield mix(np.array([short], np.uint64) + PLACE[-2] * np.array([count], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def permutations(n: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(0, 2**31, (n, 2), dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(sets: list[np.ndarray], perms: np.ndarray) -> np.ndarray:
    """Least permuted value of each set [set, permutation]; all ones for empty sets."""
    out = np.full((len(sets), len(perms)), 0xFFFFFFFF, np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        joined = np.concatenate([sets[i] for i in full])
        at = np.concatenate([[0], np.cumsum([len(sets[i]) for i in full])[:-1]])
        low, high = joined.astype(np.uint32), (joined >> np.uint64(32)).astype(np.uint32)
        for p, (a, b) in enumerate(perms):
            v = low * a
            v += high * b
            v ^= v >> np.uint32(16)
            v *= np.uint32(0x7FEB352D)
            out[full, p] = np.minimum.reduceat(v, at)
    return out


def set_digest(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(values.tobytes())


def meets(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, of sorted distinct values."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if not len(small) or 100 * len(small) < percent * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
