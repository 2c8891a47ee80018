"""64-bit hashes of words and word windows, computed in bulk from Arrow text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK_BYTES = 256 << 10

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_CODES = np.random.default_rng(20240101).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = np.uint64(0xD1342543DE82EF95)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit over the whole word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(n, CHUNK_BYTES).bit_length()
    if size not in _powers:
        _powers.clear()
        made = []
        for base in (_BASE, _INVERSE):
            row = np.full(size, base, np.uint64)
            row[0] = 1
            made.append(np.cumprod(row, dtype=np.uint64))
        _powers[size] = (made[0], made[1])
    return _powers[size]


def forget_powers() -> None:
    """Drop the kept powers: a long text leaves a large table of them."""
    _powers.clear()


@dataclass
class Words:
    """Words of consecutive texts: ``hashes[at[d]:at[d + 1]]`` are those of text ``d``.

    ``starts`` and ``ends`` are byte positions within ``data``.
    """

    hashes: np.ndarray
    at: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    data: np.ndarray

    def __len__(self) -> int:
        return len(self.at) - 1

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` words from each word on; those that cross texts mean nothing."""
        n = max(len(self.hashes) - width + 1, 0)
        h = np.zeros(n, np.uint64)
        for j in range(width):
            h = h * _STEP + self.hashes[j : j + n]
        return mix(h)


def words_of(column: pa.Array, lower: bool = False) -> Iterator[tuple[int, Words]]:
    """Words between ASCII white space, for runs of texts; a null has none.  Yields (first row, Words)."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1, first + 1)
        data, edges = whole[at[first] : at[last]], at[first : last + 1] - at[first]
        yield first, _hashed(data, edges, lower)
        first = last


def _hashed(data: np.ndarray, edges: np.ndarray, lower: bool) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(edges), np.int64), none, none, data)
    inside = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[edges] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    end[:-1] &= ~inside[1:] | cut[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    power, inverse = _power(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_CODES[_LOWER[data] if lower else data] * power[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * inverse[starts])
    return Words(hashes, np.searchsorted(starts, edges), starts, ends, data)
