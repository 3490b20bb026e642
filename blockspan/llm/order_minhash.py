"""Order MinHash of a sequence of shingles."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, comb, log, log1p

import numpy as np

from .sequences import mix

U = np.uint64


@lru_cache(None)
def families(threshold: float, miss: float = 0.005) -> tuple[tuple[int, int, int, int], ...]:
    """Fewest and most shingles of a sequence, minima a sketch, sketches.

    Short sequences can be told apart by few minima, long ones by more: as many as keep the
    chance that two of the threshold's similarity agree in a sketch near a half, a quarter,
    an eighth. Ranges of lengths overlap so far that two such sequences have one in common.
    Sketches are as many as make the chance to agree in none smaller than ``miss``, for the
    least lucky pair of lengths.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold is above 0, at most 1")
    out, least = [], 1
    for most, chance in ((12, 0.5), (40, 0.26), (1 << 62, 0.134)):
        size = int(log(chance) / log(threshold)) if threshold < 1 else 9
        # Two that differ at all have so many places in common, at the least.
        size = max(1, min(size, max(int(threshold / (1 - threshold)) if threshold < 1 else 9, 2 * least // 3)))
        # With u places in all, m of them in common, the least sizes of both are among the m.
        unions = range(max(2, least), int(min(most, 4 * least + 400) * 2) + 1)
        worst = min((comb(m, size) / comb(u, size) for u in unions if (m := ceil(threshold * u - 1e-9)) < u and m >= size), default=1.0)
        out.append((least, most, size, 1 if worst >= 1 else max(1, ceil(log(miss) / log1p(-worst)))))
        least = max(1, int(most * threshold))
    return tuple(out)


def occurrences(s: np.ndarray) -> np.ndarray:
    """For each element how many equal ones stand before it."""
    order = np.argsort(s, kind="stable")
    t = s[order]
    new = np.r_[True, t[1:] != t[:-1]]
    at = np.arange(len(s))
    out = np.empty(len(s), np.int64)
    out[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return out


def labelled(s: np.ndarray) -> np.ndarray:
    """Each element with the number of equal ones before it, so that all are distinct."""
    nth = occurrences(s)
    return np.where(nth > 0, mix(s ^ mix(nth.astype(U), 2), 3), s)


def sketches(s: np.ndarray, threshold: float) -> np.ndarray:
    """Bucket keys of a sequence: for each of a family's hash functions the shingles,
    labelled by occurrence, whose hashes are the extreme ones, in the order in which they
    stand in the text: the smallest of all, and the largest of first occurrences.

    The latter keep texts apart that have nothing in common but a line said very often.
    """
    n = len(s)
    if not n:
        return np.zeros(0, U)
    nth = occurrences(s)
    s = np.where(nth > 0, mix(s ^ mix(nth.astype(U), 2), 3), s)
    first = np.flatnonzero(nth == 0)
    out = []
    for f, (least, most, size, count) in enumerate(families(threshold)):
        if not least <= n <= most:
            continue
        n_low, n_high = min(n, size - size // 2), min(len(first), size // 2)
        seeds = np.arange(1000 * (f + 1), 1000 * (f + 1) + count).astype(U)
        key = mix(seeds, 5)
        step = max(1, 40_000 // n)  # hash functions at a time, for the cache's sake
        for j in range(0, count, step):
            h = mix(s[None, :] ^ mix(seeds[j : j + step], 6)[:, None])
            if n_high and len(first) == n:
                at = np.argpartition(h, (n_low - 1, n - n_high), axis=1)
                at = np.concatenate((at[:, :n_low], at[:, n - n_high :]), axis=1)
            else:
                at = np.argpartition(h, n_low - 1, axis=1)[:, :n_low]
                if n_high:
                    high = np.argpartition(h[:, first], len(first) - n_high, axis=1)[:, len(first) - n_high :]
                    at = np.concatenate((at, first[high]), axis=1)
            extremes = np.take_along_axis(h, np.sort(at, axis=1), axis=1)
            for x in extremes.T:
                key[j : j + step] = mix(key[j : j + step] ^ x, 4)
        out.append(key)
    return np.concatenate(out)
