"""Words of Arrow text columns and their 64-bit hashes, for many texts at once.

A hash is a polynomial over random byte values, mixed at the end. Two of n different
strings share a hash with a chance of about n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from geomarket.llm.tasks import process_state

CHUNK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C13
_ODD = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads each bit over all others."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def byte_class(inside: Iterator[int]) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(inside)] = True
    return table


# All but the space and 0x09 to 0x0D.
NOT_SPACE = byte_class(b for b in range(256) if b != 0x20 and not 0x09 <= b <= 0x0D)
# Digits, letters and every byte of a character beyond ASCII.
ALPHANUMERIC = byte_class(b for b in range(256) if 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b >= 128)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    state = process_state("powers")
    if len(state.get("up", ())) < n:
        size = max(n, CHUNK_BYTES + 1)
        up = np.full(size, _BASE, dtype=np.uint64)
        down = np.full(size, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        state["up"], state["down"] = np.cumprod(up), np.cumprod(down)
    return state["up"], state["down"]


class Hasher:
    """Hashes of any substring of one byte array, each in constant time."""

    def __init__(self, data: np.ndarray, values: np.ndarray):
        up, self.down = _powers(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(values[data] * up[:len(data)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        raw = (self.sums[end] - self.sums[start]) * self.down[start]
        return mix(raw + (end - start).astype(np.uint64) * _ODD)


class Chunk(NamedTuple):
    first: int  # row of the batch
    data: np.ndarray  # bytes of the texts, one after another
    offsets: np.ndarray  # where each text begins, and the end of the last

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Runs of texts of about ``limit`` bytes together, or one longer text; null counts as empty."""
    if not len(column):
        return
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < len(texts):
        stop = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1)
        yield Chunk(row, data[offsets[row]:offsets[stop]], offsets[row:stop + 1] - offsets[row])
        row = stop


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # the word's text, from 0
    hash: np.ndarray


def words(chunk: Chunk, kept: np.ndarray, fold_case: bool = True) -> Words:
    """Maximal runs of bytes of a class; none crosses the end of a text."""
    data, offsets = chunk.data, chunk.offsets
    inside = kept[data]
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    ends = offsets[1:][offsets[1:] > 0] - 1
    before[begins] = False
    after[ends] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, row, Hasher(data, byte_values(fold_case))(start, end))


def windows(found: Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``width`` words within one text."""
    n = len(found.start) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    first = np.flatnonzero(found.row[:n] == found.row[width - 1:])
    total = np.full(len(first), width, dtype=np.uint64)
    for k in range(width):
        total = mix(total * _ODD + found.hash[first + k])
    return first, total
