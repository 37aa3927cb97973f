"""Vectorised 64-bit hashes of words and shingles over the bytes of many texts at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from .scratch import flat, words

_M1, _M2, _BASE = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x + np.uint64((seed * _BASE + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


#: A random number for each byte, the same in every process.
BYTE_CODES = mix(np.arange(256, dtype=np.uint64), 7)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_PARTS = mix(np.arange(16, dtype=np.uint64), 11) | np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and of its inverse."""
    if not len(_powers) or len(_powers["up"]) < n:
        most = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 2**64))):
            line = np.full(most, base, np.uint64)
            line[0] = 1
            _powers[name] = np.multiply.accumulate(line)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """n + 1 running sums; ``(sums[e] - sums[s]) * down[s]`` is the hash of bytes s to e wherever they stand."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[data] * powers(len(data))[0], out=sums[1:])
    return sums


def shingle_sets(column: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each text, in order of text and hash, and text numbers.

    A-Z count as a-z. A text with fewer words has one hash, of its whole sequence; one without words none.
    """
    data, at = flat(column)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = LOWER[data]
    starts, ends, rows = words(data, at)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums, down = prefix_hash(data), powers(len(data) + 1)[1]
    word = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64), 1)
    count = np.bincount(rows, minlength=len(at) - 1)
    hashes, of = [], []
    if len(word) >= width:
        whole = np.flatnonzero(rows[: len(rows) - width + 1] == rows[width - 1 :])
        total = np.zeros(len(whole), np.uint64)
        for k in range(width):
            total += word[whole + k] * _PARTS[k]
        hashes.append(mix(total, 2))
        of.append(rows[whole])
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        first = np.searchsorted(rows, short)
        total = np.zeros(len(short), np.uint64)
        for k in range(width - 1):
            has = count[short] > k
            total[has] += word[first[has] + k] * _PARTS[k]
        hashes.append(mix(total + count[short].astype(np.uint64) * _PARTS[15], 3))
        of.append(short)
    h, r = np.concatenate(hashes), np.concatenate(of)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    return h[new], r[new]
