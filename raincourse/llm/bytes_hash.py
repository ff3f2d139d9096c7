"""Words and their hashes for a whole Arrow batch at once, in numpy.

A batch is cut into slices of about ``SLICE`` bytes at document borders, so memory is
bounded by the slice or by the longest document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U(33))
    x = x * U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U(33))


def slices(texts: pa.Array, limit: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row starts within them with one more at the end); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, where, data = texts.buffers()
    if len(texts) == 0:
        return
    offsets = np.frombuffer(where, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, len(texts))
        yield row, end, raw[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


class Hasher:
    """Hash of any byte interval of a slice from one prefix sum."""

    BASE = U(0x9E3779B97F4A7C15)
    INVERSE = U(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

    def __init__(self):
        self.values = mix(np.arange(1, 257, dtype=U))
        self.power = self.inverse = np.ones(1, U)

    def _grow(self, n: int) -> None:
        if len(self.power) <= n:
            size = max(n + 1, SLICE + 1)
            for name, base in (("power", self.BASE), ("inverse", self.INVERSE)):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))

    def intervals(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        self._grow(len(data))
        total = np.zeros(len(data) + 1, U)
        np.cumsum(self.values[data] * self.power[:len(data)], out=total[1:], dtype=U)
        return mix((total[ends] - total[starts]) * self.inverse[starts] + (ends - starts).astype(U))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def runs(kinds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of equal non-zero kind inside each row: starts, ends, and the row of each run."""
    n = len(kinds)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, none
    edge = np.zeros(n + 1, bool)
    edge[1:n] = kinds[1:] != kinds[:-1]
    edge[rows[:-1][rows[:-1] < n]] = True
    edge[0] = edge[n] = True
    at = np.flatnonzero(edge)
    starts, ends = at[:-1], at[1:]
    keep = kinds[starts] != 0
    starts, ends = starts[keep], ends[keep]
    return starts, ends, np.searchsorted(rows, starts, "right") - 1


def word_kinds(data: np.ndarray) -> np.ndarray:
    """1 for a byte of a word, 0 for the white space U+0020 and U+0009 to U+000D."""
    table = np.ones(256, np.uint8)
    table[[0x20, 9, 10, 11, 12, 13]] = 0
    return table[data]
