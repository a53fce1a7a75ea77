"""Vectorised word splitting and hashing over Arrow blocks of UTF-8 text.

Every function works on the raw bytes of many documents at once.  A word is a
maximal run of bytes other than U+0020 and U+0009..U+000D; the bytes of
multi-byte UTF-8 sequences never fall in that range, so bytes and code points
give the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa

#: Bytes of text handled by one vectorised step; a longer document is a step of its own.
BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_BYTES = LOWER.tobytes()

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(maxsize=4)
def _powers(size: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and its inverse modulo 2**64 for ``i < size``."""
    inverse = pow(base, -1, 1 << 64)
    up, down = np.ones(size, dtype=np.uint64), np.ones(size, dtype=np.uint64)
    up[1:], down[1:] = base & _MASK, inverse
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def powers(size: int, base: int = _BASE) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(1 << 16, 1 << int(size).bit_length()), base)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Block:
    """Some consecutive rows of a batch with their text bytes."""

    rows: pa.RecordBatch
    data: np.ndarray  # uint8, all texts one after another
    offsets: np.ndarray  # int64, len(rows) + 1

    def column(self, name: str) -> pa.Array:
        return self.rows.column(name)


@dataclass
class Words:
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # row of the block that each word belongs to


def blocks(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Split batches into blocks of about ``limit`` text bytes; a null text has no bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(text)
        if not pa.types.is_large_binary(column.type):
            column = column.cast(pa.binary()).cast(pa.large_binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())
        column = column.fill_null(b"")
        _, offset_buffer, data_buffer = column.buffers()
        offsets = np.frombuffer(offset_buffer, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(data_buffer, dtype=np.uint8) if data_buffer is not None and data_buffer.size else np.zeros(0, np.uint8)
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield Block(batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
            first = last


def split_words(block: Block, stops: np.ndarray = SPACE) -> Words:
    data, offsets = block.data, block.offsets
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return Words(empty, empty, empty)
    inside = ~stops[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    before[inner] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[inner - 1] = False
    start = np.flatnonzero(inside & ~before)
    return Words(start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(offsets, start, side="right") - 1)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, equal for equal bytes wherever they lie."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive entries; entry ``i`` covers ``i .. i+size-1``."""
    if len(hashes) < size:
        return np.zeros(0, dtype=np.uint64)
    up, down = powers(len(hashes) + 1, 0xC2B2AE3D27D4EB4F)
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum(hashes * up[: len(hashes)], out=total[1:])
        return mix((total[size:] - total[:-size]) * down[: len(total) - size])


def as_long(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def counts_by_row(rows: np.ndarray, size: int, weights: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(rows, weights, minlength=size)[:size]
