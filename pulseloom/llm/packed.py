"""Arrays of 64-bit values as compressed strings, for messages between chunks and buckets."""

from __future__ import annotations

import numpy as np
import zstandard


def pack(values: np.ndarray) -> bytes:
    """Small values take a byte or two each."""
    return zstandard.compress(values.astype(np.uint64).view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    """Rising values, by their differences."""
    return pack(np.diff(values, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of the upper 32 bits."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def slices(hashes: np.ndarray, buckets: int, sort: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and bounds of hashes in the order of their buckets; with ``sort`` bounds and that order."""
    of = bucket_of(hashes, buckets)
    order = np.argsort(of, kind="stable") if sort else None
    at = np.searchsorted(of[order] if sort else of, np.arange(buckets + 1).astype(np.uint64))
    return (at, order) if sort else (np.arange(buckets), at)
