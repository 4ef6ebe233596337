"""Number columns as compressed bytes, and how tasks write and meet sorted runs of them. Runs inside Python workers."""

from __future__ import annotations

import struct

import numpy as np
import zstandard

_HEAD = struct.Struct("<cBQQ")


def pack(*columns: np.ndarray) -> bytes:
    """Flat number columns as zstd frames, byte planes apart so that high bytes compress."""
    squeeze, out = zstandard.ZstdCompressor(level=1).compress, []
    for c in columns:
        c = np.ascontiguousarray(c)
        planes = c.view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() if len(c) else b""
        frame = squeeze(planes)
        out += [_HEAD.pack(c.dtype.kind.encode(), c.itemsize, len(c), len(frame)), frame]
    return b"".join(out)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns that `pack` was given."""
    expand, at, out = zstandard.ZstdDecompressor().decompress, 0, []
    while at < len(blob):
        kind, size, n, length = _HEAD.unpack_from(blob, at)
        at += _HEAD.size
        planes = expand(blob[at:at + length], max_output_size=n * size) if n else b""
        at += length
        out.append(np.ascontiguousarray(np.frombuffer(planes, dtype=np.uint8).reshape(size, n).T).reshape(-1).view(f"<{kind.decode()}{size}"))
    return out


def starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted columns read side by side."""
    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    if n:
        new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def radix_of(hashes: np.ndarray, radices: int) -> np.ndarray:
    """Number of the equal slice of the hash range that each 64-bit hash falls into; grows with the hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(radices) >> np.uint64(32)).astype(np.int64)


def slices(radix: np.ndarray) -> list[tuple[int, int, int]]:
    """(radix, from, to) of every run of equal values in a sorted column."""
    at = starts(radix)
    return list(zip(radix[at].tolist(), at.tolist(), [*at[1:].tolist(), len(radix)])) if len(at) else []
