"""Hashed word shingles of many texts at once, in numpy.

Words are runs of bytes other than space and 0x09-0x0D, A-Z lower-cased. A word's hash is a polynomial over random 64-bit
values of its bytes, taken from prefix sums; a shingle's mixes the hashes of its words. Different shingles of one comparison
collide with a chance of about 2**-60.
"""

from __future__ import annotations

import numpy as np

SIZE = 5
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.default_rng(20240229).integers(1, 2**64 - 1, 256, np.uint64)
_VALUES[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FACTORS = np.random.default_rng(7).integers(1, 2**64 - 1, SIZE, np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input reaches every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> list[np.ndarray]:
    if len(_POWERS[0]) < n:
        for i, base in enumerate((_BASE, _INVERSE)):
            step = np.full(n, base, np.uint64)
            step[0] = 1
            _POWERS[i] = np.cumprod(step)
    return _POWERS


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of 1 to SIZE - 1 words the whole sequence, of none nothing."""
    raw = [t.encode() for t in texts]
    flat = np.frombuffer(b" ".join([b"", *raw, b""]), np.uint8)
    first_byte = np.cumsum([1] + [len(r) + 1 for r in raw])
    space = _SPACE[flat]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    power, inverse = _powers(len(flat))
    sums = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(np.where(space, np.uint64(0), _VALUES[flat]) * power[: len(flat)], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(_BASE))
    del sums
    first_word = np.searchsorted(starts, first_byte)
    total = np.zeros(max(len(words) - SIZE + 1, 0), np.uint64)
    for k in range(SIZE):
        total += words[k : len(words) - SIZE + 1 + k] * _FACTORS[k]
    total = mix(total)
    out = []
    for lo, hi in zip(first_word[:-1].tolist(), first_word[1:].tolist(), strict=True):
        n = hi - lo
        if n >= SIZE:
            out.append(np.unique(total[lo : hi - SIZE + 1]))
        elif n:
            out.append(mix((words[lo:hi] * _FACTORS[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out
