"""Vectorised word scanning over UTF-8 bytes inside Arrow batches.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D; UTF-8 never uses those
bytes inside a longer sequence, so scanning bytes equals scanning code points.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Odd multipliers of the two independent polynomial word hashes (any odd 64-bit number serves).
MULT = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
SEGMENT = 1 << 20
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (shift, multiply)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(mult: np.uint64, n: int) -> np.ndarray:
    """mult**0 .. mult**(n-1) modulo 2**64, kept between calls."""
    p = _powers.get(int(mult))
    if p is None or len(p) < n:
        size = max(256, 1 << (n - 1).bit_length())
        p = np.full(size, mult, dtype=np.uint64)
        p[0] = 1
        p = np.multiply.accumulate(p)
        if size <= 1 << 21:
            _powers[int(mult)] = p
    return p


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each row's bounds in them; null is empty."""
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        column, kind = column.cast(pa.string()), np.int32
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    bounds = np.frombuffer(offs, dtype=kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte spans of all words, and for each row the index of its first word.

    ``first`` has one entry more than there are rows.
    """
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(bounds), np.int64)
    space = SPACE[data]
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = space[:-1]
    cut = bounds[:-1]
    before[cut[cut < n]] = True
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = space[1:]
    cut = bounds[1:] - 1
    after[cut[cut >= 0]] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; segments of about a megabyte at a time."""
    out = np.empty(len(starts), np.uint64)
    lens = ends - starts
    if not len(starts):
        return out
    total = np.cumsum(lens)
    lo = 0
    while lo < len(starts):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + SEGMENT, side="right")))
        ln = lens[lo:hi]
        own = np.concatenate(([0], np.cumsum(ln)[:-1]))
        rel = np.arange(int(ln.sum()), dtype=np.int64) - np.repeat(own, ln)
        at = rel + np.repeat(starts[lo:hi], ln)
        value = (data[at].astype(np.uint64) + np.uint64(1)) * powers(MULT[which], int(ln.max()))[rel]
        out[lo:hi] = np.add.reduceat(value, own)
        lo = hi
    return mix(out + lens.astype(np.uint64) * MULT[1 - which])


def grams(h: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, by doubling: O(log n) passes."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    mult = MULT[which]
    power = lambda k: np.uint64(pow(int(mult), k, 1 << 64))
    acc, have, block, size = None, 0, h, 1
    left = n
    while left:
        if left & 1:
            m = len(h) - (have + size) + 1
            part = block[have : have + m]
            acc = part if acc is None else acc[:m] * power(size) + part
            have += size
        left >>= 1
        if left:
            block = block[:-size] * power(size) + block[size:] if len(block) > size else block[:0]
            size *= 2
    return mix(acc)


def rolling_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    size, cur = 1, x
    while size * 2 <= width:
        cur = np.minimum(cur[:-size], cur[size:])
        size *= 2
    rest = width - size
    return np.minimum(cur[: len(cur) - rest], cur[rest:]) if rest else cur


def run_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray, which: int = 0) -> np.ndarray:
    """Hashes of the word runs [start, end), by prefix sums."""
    n = len(h)
    mult = int(MULT[which])
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * powers(MULT[which], n)[:n], dtype=np.uint64)))
    back = powers(np.uint64(pow(mult, -1, 1 << 64)), n)[start]
    return mix((total[end] - total[start]) * back + (end - start).astype(np.uint64))
