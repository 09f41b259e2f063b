"""Word and shingle hashes of whole texts, computed array-wise.

Words are runs of bytes other than ASCII white space in the UTF-8 text, A-Z lower-cased.
"""

from __future__ import annotations

import numpy as np

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTES[SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_power, _unpower = _powers(_BASE, 1 << 15), _powers(_INVERSE, 1 << 15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads each bit over all."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    x ^= x >> _U(33)
    return x


#: What divides words where punctuation isn't to count: all ASCII but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def word_hashes(text: bytes, between: np.ndarray = SPACE) -> np.ndarray:
    """A 64-bit hash of each word, in order."""
    global _power, _unpower
    data = np.frombuffer(text.lower(), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    inside = ~between[data]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    if not len(starts):
        return np.empty(0, np.uint64)
    while len(data) > len(_power):
        _power, _unpower = _powers(_BASE, 2 * len(_power)), _powers(_INVERSE, 2 * len(_unpower))
    values = _BYTES[data] * _power[: len(data)]
    values[~inside] = 0
    sums = np.add.reduceat(values, starts)
    return mix(sums * _unpower[starts])


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of `size` words; of fewer words, one of them all."""
    n = len(words)
    if not n:
        return words
    span = min(size, n)
    acc = np.full(n - span + 1, span, np.uint64)
    for k in range(span):
        acc = (acc * _U(0x2545F4914F6CDD1D)) + words[k : n - span + 1 + k]
        acc ^= acc >> _U(29)
    return np.unique(mix(acc))
