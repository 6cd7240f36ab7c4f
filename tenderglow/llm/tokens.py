"""Words of texts and their hashes, a whole Arrow batch at a time in numpy.

A word is a run of bytes other than space and tab to carriage return, so UTF-8 letters are never cut. The hash of a word
is a polynomial of its bytes modulo 2**64, mixed; it depends on nothing but the bytes, hence equal on all machines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse
_MASK = (1 << 64) - 1
_PIECE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers whose bits all depend on each other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = _PIECE if n <= _PIECE else n
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        tables = np.cumprod(up), np.cumprod(down)
        if size > _PIECE:
            return tables
        _powers[size] = tables
    return _powers[size]


@dataclass
class Words:
    """The words of some consecutive documents of a batch.

    ``first`` and ``last`` bound the rows; ``bounds`` has where each document's words begin; ``start`` and ``end`` are
    places in ``data``, the bytes of these documents; ``offsets`` has where each document's bytes begin.
    """

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hashes: np.ndarray

    def of(self, i: int) -> slice:
        return slice(self.bounds[i], self.bounds[i + 1])

    @property
    def doc(self) -> np.ndarray:
        """The document number of each word, from 0."""
        return np.repeat(np.arange(self.last - self.first), np.diff(self.bounds))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column without copying; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(places, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def _hash_piece(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, down = _power_tables(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64))


def split(data: np.ndarray, offsets: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word; words end at the end of a document. Works in pieces of about 1 MB."""
    ink = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], ink[:-1]]) if len(data) else ink
    start = np.flatnonzero(ink & (~before | edge[:-1]))
    after = np.concatenate([ink[1:], [False]]) if len(data) else ink
    end = np.flatnonzero(ink & (~after | edge[1:])) + 1
    hashes = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        # As many whole words as fit into a piece, at least one.
        to = max(at + 1, int(np.searchsorted(end, start[at] + _PIECE, "right")))
        low, high = start[at], end[to - 1]
        piece = data[low:high]
        hashes[at:to] = _hash_piece(LOWER[piece] if lower else piece, start[at:to] - low, end[at:to] - low)
        at = to
    return start, end, hashes


def groups(column: pa.Array, lower: bool, most: int = 4 << 20) -> Iterator[Words]:
    """The words of a text column, in groups of documents of about ``most`` bytes (longer only for one long document)."""
    data, offsets = buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        part = data[offsets[row]:offsets[last]]
        places = offsets[row:last + 1] - offsets[row]
        start, end, hashes = split(part, places, lower)
        yield Words(row, last, part, places, np.searchsorted(start, places), start, end, hashes)
        row = last


def ngram_hashes(hashes: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of ``n`` words, by its first word; runs across documents are the caller's to drop."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    factor = np.uint64((_BASE + 2 * seed) & _MASK | 1)
    for i in range(n):
        out *= factor
        out += hashes[i:count + i]
    return mix(out ^ np.uint64(seed * 0x632BE59BD9B4E019 & _MASK))
