"""Words of many texts at once, as NumPy arrays over their UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of words: all but ASCII white space; ASCII letters and digits, and all beyond ASCII.
NOT_WHITE = np.ones(256, bool)
NOT_WHITE[[9, 10, 11, 12, 13, 32]] = False
ALPHANUMERIC = np.zeros(256, bool)
ALPHANUMERIC[48:58] = ALPHANUMERIC[65:91] = ALPHANUMERIC[97:123] = ALPHANUMERIC[128:] = True

_BASE = np.uint64(0x9E3779B97F4A7C15)
_VALUES = np.random.default_rng(20240101).integers(1, 2**63, 256, dtype=np.uint64)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def _grow(n: int) -> None:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << n.bit_length()
        back = np.uint64(pow(int(_BASE), -1, 1 << 64))
        _powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, _BASE)]), dtype=np.uint64)
        _inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, back)]), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def text_slices(column: pa.Array, size: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about ``size`` bytes: first row, offsets, bytes. Null is empty."""
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        last = min(last, len(column))
        cut = offsets[first : last + 1]
        yield first, cut - cut[0], data[cut[0] : cut[-1]]
        first = last


class Words:
    """The words of a slice: ``start``, ``end`` (bytes), ``doc`` (row in the slice), ``hash``."""

    def __init__(self, offsets: np.ndarray, data: np.ndarray, kind: np.ndarray):
        self.data = _LOWER[data]
        n = len(data)
        inside = kind[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets[1:], self.start, "right")
        #: Words of texts before each text, and of all.
        self.first = np.searchsorted(self.doc, np.arange(len(offsets)))
        _grow(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUES[self.data] * _powers[:n], out=total[1:])
        self._total = total
        self.hash = self._hash(self.start, self.end)

    def _hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        value = (self._total[end] - self._total[start]) * _inverse[start]
        return mix(value + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def prefixes(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(word, hash of its first n bytes) of the words with more than n bytes."""
        at = np.flatnonzero(self.end - self.start > n)
        start = self.start[at]
        return at, self._hash(start, start + n) ^ np.uint64(0xA5A5A5A5A5A5A5A5)

    def text(self, a: int, b: int) -> bytes:
        """Words a to b-1, space-joined."""
        return b" ".join(self.data[self.start[i] : self.end[i]].tobytes() for i in range(a, b))
