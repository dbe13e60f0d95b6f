"""Arrays packed into bytes, so that many small numbers travel and lie as one value."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, then zstd: the empty upper bytes of small numbers cost nothing."""
    planes = np.ascontiguousarray(values.astype("<i8").view("u1").reshape(-1, 8).T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), "u1").reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<i8").ravel()


def pack_floats(values: np.ndarray) -> bytes:
    """Few distinct values are the rule, so they are listed once."""
    kinds, codes = np.unique(values, return_inverse=True)
    return pack(np.concatenate([[len(kinds)], kinds.view("<i8"), codes]))


def unpack_floats(data: bytes) -> np.ndarray:
    found = unpack(data)
    n = int(found[0])
    return found[1:n + 1].view("<f8")[found[n + 1:]]


def spread(values: np.ndarray) -> np.ndarray:
    """Equal numbers give equal, well mixed ones."""
    x = values.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def names_of(columns: str) -> list[str]:
    return [c.split()[0] for c in columns.split(", ")]


def cuts(parts: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(part, start, end) of each run of a sorted array."""
    starts = np.flatnonzero(np.diff(parts, prepend=-1))
    return zip(parts[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(parts)])
