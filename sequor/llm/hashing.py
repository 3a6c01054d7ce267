"""Vectorised word and shingle hashes over Arrow string buffers.

Words are maximal runs of bytes other than space and 0x09-0x0D.  A word's hash
is keyed and takes in eight of its UTF-8 bytes at a time, mixing fully after
each, so that no pattern of letters makes words collide; it depends on the word
alone and agrees between tasks, runs and machines.  Hashes have 64 bits: where a
result must not rest on them, words are compared besides.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_MUL = np.uint64(0xD1342543DE82EF95)
#: Keys of the word hash: of its length, of the bytes taken in, and of each step.
_K_LENGTH, _K_BYTES, _K_STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
#: Of a rest of n bytes of eight, the bits that count.
_REST = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of text hashed at a time; a longer single text is a chunk of its own.
CHUNK_BYTES = 256 << 10

def trim() -> None:
    """Hand freed memory back, so that a reused worker starts its next stage small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Words:
    """The words of a run of documents: byte spans, hashes, and word offsets by document."""

    first_row: int
    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.offsets[i] : self.offsets[i + 1]]


def words(column: pa.Array | pa.ChunkedArray, lower: bool) -> Iterator[Words]:
    """The words of every row of a string column, in chunks of rows; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return
    bounds = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, side="right")) - 1)
        stop = min(stop, len(column))
        at = bounds[row : stop + 1] - bounds[row]
        part = raw[bounds[row] : bounds[stop]]
        if lower:
            part = _LOWER[part]
        yield _hashed(row, part, at)
        row = stop


def _hashed(row: int, data: np.ndarray, at: np.ndarray) -> Words:
    n = len(data)
    inside = np.empty(n + 1, dtype=bool)
    inside[:n] = ~_SPACE[data]
    inside[n] = False
    begins = inside[:n].copy()
    begins[1:] &= ~inside[: n - 1] if n else False
    inner = at[(at > 0) & (at < n)]
    begins[inner] = inside[inner]
    last = inside[:n] & ~inside[1 : n + 1]
    last[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(last) + 1
    return Words(row, data, starts, ends, word_hashes(data, starts, ends), np.searchsorted(starts, at))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Keyed hashes of byte spans, taken in eight bytes at a time with a full mix after each.

    Spans of one length up to eight bytes never share a hash, as each step is a
    bijection; longer ones do so with the odds of 64 bits.
    """
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.as_strided(held[:8].view("<u8"), shape=(len(data) + 1,), strides=(1,))
    size = ends - starts
    with np.errstate(over="ignore"):
        out = mix64(size.astype(np.uint64) * _K_LENGTH + _K_BYTES)
        todo, at, left = np.arange(len(starts)), starts, size
        while len(todo):
            part = eights[at] & _REST[np.minimum(left, 8)]
            out[todo] = mix64((out[todo] ^ part) * _K_STEP + _K_BYTES)
            more = left > 8
            todo, at, left = todo[more], at[more] + 8, left[more] - 8
    return out


def grams(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive words; empty when there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        out = hashes[:n].copy()
        for j in range(1, size):
            out *= _MUL
            out += hashes[j : j + n]
    return mix64(out)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; fewer words than ``size`` make one shingle, none make none."""
    if not len(hashes):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(grams(hashes, min(size, len(hashes))))
