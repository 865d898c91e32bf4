"""Plain versions of the operators' rules, for small tables."""

import hashlib
import re
from collections import Counter

import xxhash


def repeats(units: list, length: int) -> list[list[bool]]:
    """Which units of each sequence lie in a window of ``length`` units that starts more than once."""
    seen = Counter(bytes(u[i:i + length]) if isinstance(u, bytes) else tuple(u[i:i + length]) for u in units for i in range(len(u) - length + 1))
    out = []
    for u in units:
        mark = [False] * len(u)
        for i in range(len(u) - length + 1):
            if seen[bytes(u[i:i + length]) if isinstance(u, bytes) else tuple(u[i:i + length])] > 1:
                mark[i:i + length] = [True] * length
        out.append(mark)
    return out


def byte_digest(texts: list, length: int) -> list[tuple]:
    data = [(t or "").encode() for t in texts]
    out = []
    for d, m in zip(data, repeats(data, length)):
        runs = sum(x and not (i and m[i - 1]) for i, x in enumerate(m))
        out.append((len(d), sum(m), runs, hashlib.sha256(bytes(c for c, x in zip(d, m) if not x)).hexdigest()))
    return out


def words(text) -> list[bytes]:
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", (text or "").encode()) if w]


def word_digest(texts: list, length: int) -> list[tuple]:
    data = [words(t) for t in texts]
    return [(len(d), sum(m), hashlib.sha256(b" ".join(w for w, x in zip(d, m) if not x)).hexdigest())
            for d, m in zip(data, repeats(data, length))]


def fingerprint(text, shingle: int = 3) -> int:
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    parts = [b" ".join(w[i:i + shingle]) for i in range(len(w) - shingle + 1)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(prints: list[int], distance: int = 3) -> list[int]:
    """Index of the first member of each one's component."""
    label = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= distance and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def least_distance(pattern: str, text: str) -> tuple[int, int]:
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row), row.index(min(row))
