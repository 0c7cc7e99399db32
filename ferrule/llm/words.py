"""Words and shingles of many texts at once, as 64-bit hashes."""

from __future__ import annotations

import numpy as np

from .common import SPACE_CHARS

U = np.uint64
_BASE = U(0x9E3779B97F4A7C15)  # odd, so that it has an inverse modulo 2**64
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_STEP = U(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += U(32)
_LOWER += U(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[ord(c) for c in SPACE_CHARS]] = True
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        tables = []
        for base in (_BASE, _INVERSE):
            table = np.full(n, base, np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        _powers = tuple(tables)
    return _powers


def words(data: np.ndarray, offsets: np.ndarray, span: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each word of each row, A-Z lower-cased, and the rows' offsets into the hashes."""
    n = len(data)
    space = _IS_SPACE[data]
    fresh = np.ones(n + 1, bool)  # what lies before this byte belongs to no word that reaches it
    fresh[1:n] = space[:-1]
    fresh[offsets] = True
    solid = ~space
    starts = np.flatnonzero(solid & fresh[:-1])
    last = np.ones(n, bool)
    last[:-1] = space[1:]
    last[offsets[1:][offsets[1:] > 0] - 1] = True
    ends = np.flatnonzero(solid & last) + 1
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + span, "right")))
        lo, hi = starts[a], ends[b - 1]
        power, inverse = _power_tables(max(span, hi - lo) + 1)
        sums = np.zeros(hi - lo + 1, np.uint64)
        np.cumsum(_LOWER[data[lo:hi]] * power[: hi - lo], out=sums[1:])
        out[a:b] = (sums[ends[a:b] - lo] - sums[starts[a:b] - lo]) * inverse[starts[a:b] - lo]
        a = b
    return mix(out), np.searchsorted(starts, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row its sorted distinct k-word shingles; one for a row with fewer words."""
    h, at = words(data, offsets)
    count = np.diff(at)
    m = max(0, len(h) - k + 1)
    runs = [h]
    for j in range(1, k):  # runs[j]: a hash of the j + 1 words from here
        runs.append(runs[-1][: max(0, len(h) - j)] * _STEP + h[j:])
    full = mix(runs[k - 1][:m])
    out = []
    for i, n in enumerate(count.tolist()):
        if n >= k:
            out.append(np.unique(full[at[i] : at[i] + n - k + 1]))
        elif n:
            out.append(mix(runs[n - 1][at[i] : at[i] + 1] + U(n)))
        else:
            out.append(full[:0])
    return out
