"""Synchronised positions of a unit sequence (bytes or words): the sparse position set on which repeats are ranked.

Of every window of ``length`` units one gram of ``gram`` units is chosen, the one with the least hash (leftmost on
ties).  Equal windows choose the gram at the same offset, so a window can repeat only where its chosen gram repeats.
Neighbouring windows mostly choose the same gram; such a run is a *domain*: window starts ``lo..hi`` that share one
chosen gram.  Domains cut the window starts of a text into disjoint runs, about two for every ``length - gram + 2`` units,
so ranking domains moves a small share of what ranking every position would.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

BLOCK = 1 << 16
_POSITION = np.uint64((1 << 20) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: A random 64-bit value per byte, so that byte texts hash like word texts do.
BYTE_UNITS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(10, (n - 1).bit_length())
    if size not in _CACHE:
        _CACHE[size] = _powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)
    return _CACHE[size]


def _sums(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of a rolling hash (mod 2^64) and the factors that make it independent of the position."""
    power, inverse = _tables(len(units) + 1)
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * power[: len(units)], out=sums[1:])
    return sums, inverse


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    n, done = len(x) - width + 1, 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    return np.minimum(x[:n], x[width - done : width - done + n])


def gram_length(length: int) -> int:
    """Units of the chosen gram: long enough that common phrases do not match, short enough for few domains."""
    return max(1, length - max(1, length * 4 // 5) + 1)


def domains(units: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lo, hi, gram hash) of every domain, blockwise, so memory stays bounded for texts of any length.  A domain cut by a
    block edge only loses the shortcut of equal contexts."""
    gram = gram_length(length)
    last, out = len(units) - length + 1, []
    for start in range(0, last, BLOCK):
        stop = min(start + BLOCK, last)
        x = units[start : stop + length - 1]
        sums, inverse = _sums(x)
        grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(x) - gram + 1])
        keyed = (grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64)
        at = (_least(keyed, length - gram + 1) & _POSITION).astype(np.int64)
        cut = np.flatnonzero(at[1:] != at[:-1]) + 1
        lo, hi = np.r_[0, cut], np.r_[cut - 1, len(at) - 1]
        out.append((lo + start, hi + start, grams[at[lo]].view(np.int64)))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def blocks(units: np.ndarray, length: int, gram_hash: int, width: int, hashes: Callable) -> tuple[np.ndarray, ...]:
    """The windows of one domain in blocks of ``width`` neighbours, aligned at the chosen gram so that equal windows of
    two domains fall into blocks of the same number: (number, first start, last start, hash of the units that all
    windows of the full block share, hash of the units that this domain's windows of the block cover).  ``hashes`` gives
    the hashes of stretches of the units from their starts and ends."""
    gram, n = gram_length(length), len(units) - length + 1
    sums, inverse = _sums(units)
    grams = mix((sums[gram:] - sums[:-gram]) * inverse[: len(units) - gram + 1]).view(np.int64)
    at = int(np.flatnonzero(grams == gram_hash)[0])
    number = (at - np.arange(n)) // width
    cut = np.flatnonzero(number[1:] != number[:-1]) + 1
    first, last = np.r_[0, cut], np.r_[cut - 1, n - 1]
    number = number[first]
    start = at - number * width
    return number, first, last, hashes(start, start - width + 1 + length), hashes(first, last + length)


def window_hashes(units: np.ndarray, length: int) -> np.ndarray:
    """Rolling hash of each window of ``length`` units: equal windows have equal ones, but what differs may, too (a sum of powers
    modulo 2^64 is blind to some long patterns), so it only finds candidates."""
    sums, inverse = _sums(units)
    n = len(units) - length + 1
    return mix((sums[length:] - sums[:n]) * inverse[:n] ^ np.uint64(0x94D049BB133111EB)).view(np.int64)
