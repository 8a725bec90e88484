"""Sets of hashed word shingles, formed with array operations on the bytes of a text."""

from __future__ import annotations

import numpy as np

_U = np.uint64
_BASE, _STEP = _U(0x9E3779B97F4A7C15), _U(0xD6E8FEB86659FD93)
_GAP = np.zeros(256, np.int8)
_GAP[[0x20, 9, 10, 11, 12, 13]] = 1
_powers = [np.ones(1, _U), np.ones(1, _U)]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every input bit over all 64 (a bijection)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        inverse = _U(pow(int(_BASE), -1, 1 << 64))
        for k, factor in enumerate((_BASE, inverse)):
            run = np.full(size, factor, _U)
            run[0] = 1
            _powers[k] = np.cumprod(run, dtype=_U)
    return _powers[0][:n], _powers[1][:n]


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Distinct hashes of the n-word shingles, ascending; A-Z lower-cased.

    With fewer than n words the whole sequence is one shingle; without words the set is empty.
    """
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass").lower(), np.uint8)
    gap = np.ones(len(data) + 2, np.int8)
    gap[1:-1] = _GAP[data]
    edges = np.flatnonzero(np.diff(gap))
    starts, ends = edges[0::2], edges[1::2]
    if not len(starts):
        return np.empty(0, _U)
    power, inverse = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:-1], dtype=_U, out=total[1:])
    word = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(_U))
    width = min(n, len(word))
    h = word[: len(word) - width + 1] + _U(width)
    for k in range(1, width):
        h = h * _STEP + word[k: len(word) - width + 1 + k]
    return np.unique(mix(h))


def digest(found: np.ndarray) -> int:
    """A signed 64-bit number for a set."""
    return int(mix(np.array([found.sum(dtype=_U) + _U(len(found))], _U)).view(np.int64)[0])
