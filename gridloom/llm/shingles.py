"""Shingle sets of texts, vectorised over a batch."""

from __future__ import annotations

import numpy as np

K = 5
#: Odd multipliers of the byte and word hashes.
_BYTE, _WORD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The byte multiplier's powers 0 to n and their inverses modulo 2**64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        inverse = np.uint64(pow(int(_BYTE), -1, 1 << 64))
        for k, base in enumerate((_BYTE, inverse)):
            grown = np.full(size, base, np.uint64)
            grown[0] = 1
            _powers[k] = np.multiply.accumulate(grown)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes other than white space, A-Z lower-cased)."""
    codes = _LOWER[np.frombuffer(raw, np.uint8)]
    inside = np.zeros(len(codes) + 2, bool)
    inside[1:-1] = ~_SPACE[codes]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    power, inverse = powers(len(codes))
    sums = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(_VALUE[codes] * power[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))


def combine(words: np.ndarray, k: int = K) -> np.ndarray:
    """A hash of each run of ``k`` words; of all words if there are fewer."""
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(k, len(words))):
        out = out * _WORD + words[i : i + n]
    return mix(out)


def shingle_set(text: str, k: int = K) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; empty without words."""
    words = word_hashes(text.encode("utf-8", "surrogatepass"))
    return np.unique(combine(words, k)) if len(words) else words
