"""Whole-text hashing in numpy: word spans and word hashes of an Arrow string column, a slice of bytes at a time.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 never occur inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text handled at once; a longer text is cut at spaces into runs of about this size.
SLICE = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, SLICE + 4096)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size, b, np.uint64)]) for b in (_BASE, _INVERSE)]
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64 (a copy)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary array without a copy; a null has no bytes."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def groups(offsets: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts of about limit bytes together (a longer text is alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of buf. Texts must be apart by a space: see padded()."""
    inside = np.empty(len(buf) + 2, bool)
    inside[0] = inside[-1] = False
    np.logical_not(SPACE[buf], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[0::2], edges[1::2]


def padded(raw: np.ndarray, offsets: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Texts i to j with a newline after each, and their starts there."""
    lengths = np.diff(offsets[i : j + 1])
    starts = np.r_[0, np.cumsum(lengths + 1)]
    out = np.full(starts[-1], 10, np.uint8)
    keep = np.ones(starts[-1], bool)
    keep[starts[1:] - 1] = False
    out[keep] = raw[offsets[i] : offsets[j]]
    return out, starts


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes, the same wherever the span lies. Long inputs go in slices between spans."""
    out = np.empty(len(starts), np.uint64)
    a = 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + SLICE, "right")))
        at = starts[a]
        piece = buf[at : ends[b - 1]]
        up, down = _power_tables(len(piece) + 1)
        sums = np.empty(len(piece) + 1, np.uint64)
        sums[0] = 0
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=sums[1:])
        s, e = starts[a:b] - at, ends[a:b] - at
        out[a:b] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        a = b
    return mix(out)


def windows(h: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each n neighbouring words of one text, and the text. A text of 1 to n-1 words has one window: all of it.

    h: word hashes in order; owner: the text of each, rising.
    """
    if len(h) == 0:
        return h, owner
    first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    size = np.diff(np.r_[first, len(h)])
    left = np.repeat(first + size, size) - np.arange(len(h))  # words to the end of the text
    out = np.zeros(len(h), np.uint64)
    longest = int(min(n, size.max()))
    for k in range(longest):
        out[: len(h) - k] += np.where(left[: len(h) - k] > k, mix(h[k:] + np.uint64(0x632BE59BD9B4E019 * (k + 1) & (1 << 64) - 1)), np.uint64(0))
    whole = left >= n
    whole[first[size < n]] = True
    return mix(out[whole]), owner[whole]
