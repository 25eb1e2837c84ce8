"""Vectorised 64-bit hashes of words and of runs of words (NumPy, inside tasks)."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)                       # odd, so it has an inverse
_INVERSE = _U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_STEP = 1 << 18                                      # bytes hashed at once
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POW = _powers(_BASE, 2 * _STEP)
_INV = _powers(_INVERSE, 2 * _STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the whole word."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _piece_hashes(a: np.ndarray) -> np.ndarray:
    edge = np.ones(len(a) + 2, bool)
    edge[1:-1] = _SPACE[a]
    at = np.flatnonzero(edge[1:] != edge[:-1])
    starts, ends = at[0::2], at[1::2]
    if len(a) > len(_POW):  # one word longer than the tables
        pow_, inv = _powers(_BASE, len(a)), _powers(_INVERSE, len(a))
    else:
        pow_, inv = _POW, _INV
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a + _U(1)) * pow_[:len(a)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inv[starts]
    return mix(h + (ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


def word_hashes(data: bytes) -> np.ndarray:
    """One hash for each word ``[^\\x20\\x09-\\x0D]+`` of ``data``, in order."""
    if len(data) <= _STEP:
        return _piece_hashes(np.frombuffer(data, np.uint8)) if data else np.zeros(0, np.uint64)
    a, out, lo = np.frombuffer(data, np.uint8), [], 0
    while lo < len(a):
        hi = min(len(a), lo + _STEP)
        while hi < len(a):  # up to the next white space
            gap = np.flatnonzero(_SPACE[a[hi:hi + _STEP]])
            hi = hi + int(gap[0]) if len(gap) else min(len(a), hi + _STEP)
            if len(gap):
                break
        out.append(_piece_hashes(a[lo:hi]))
        lo = hi
    return np.concatenate(out)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of every ``k`` consecutive words; a shorter, non-empty sequence
    counts as one run."""
    n = len(words)
    if n == 0:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    total = np.full(n - size + 1, _U(size * 0x2545F491 + 1), np.uint64)
    for j in range(size):
        total = mix(total + words[j:n - size + 1 + j] * _U((2 * j + 3) * 0x9E3779B97F4A7C15
                                                          % (1 << 64) | 1))
    return total


def rolling_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of every ``k`` consecutive words, each from the one
    before by one word in and one out (as differences of running sums)."""
    n = len(words)
    if n < k:
        return np.zeros(0, np.uint64)
    powers, inverse = (_POW, _INV) if n <= len(_POW) else (_powers(_BASE, n), _powers(_INVERSE, n))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(words * powers[:n], out=sums[1:])
    return (sums[k:] - sums[:-k]) * inverse[:n - k + 1]


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the text's ``k``-word shingles (A-Z lowered)."""
    if not text:
        return np.zeros(0, np.uint64)
    raw = text.encode("utf-8", "surrogatepass").lower()  # bytes: only A-Z
    return np.unique(run_hashes(word_hashes(raw), k))
