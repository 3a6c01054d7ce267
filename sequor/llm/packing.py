"""Arrays packed for the way between tasks: byte planes, compressed."""

from __future__ import annotations

import numpy as np
import zstandard


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after the other, wide ones as byte planes, compressed."""
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        planes = a.view(np.uint8).reshape(len(a), a.itemsize).T if len(a) else a.view(np.uint8)
        out.append(np.array([len(a), ord(a.dtype.char)], np.int64).tobytes() + np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpacked(blob: bytes) -> list[np.ndarray]:
    """The arrays of :func:`packed`."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        n, kind = (int(x) for x in np.frombuffer(raw, np.int64, 2, at))
        dtype = np.dtype(chr(kind))
        planes = np.frombuffer(raw, np.uint8, n * dtype.itemsize, at + 16).reshape(dtype.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(dtype).ravel())
        at += 16 + n * dtype.itemsize
    return out
