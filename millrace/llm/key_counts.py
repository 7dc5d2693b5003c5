"""Corpus-wide counts of hashed keys (shingles, n-grams), exchanged as packed blobs.

A unit of documents sends each range of the key space one blob: its keys there, sorted and written
as differences, some three bytes a key.  A key that a third of the documents hold is one entry (or a
run of entries) per unit, in the range it hashes to; ranges are even because keys are hashes.
"""

from __future__ import annotations

from math import ceil, log2

import numpy as np

from millrace.llm.hashing import pack_sorted, unpack_sorted

RANGE_BYTES = 8 << 20  # text per range of the key space
MAX_RANGE_BITS = 14


def range_bits(text_bytes: int) -> int:
    """Bits that number the key ranges of a corpus of so many bytes."""
    return min(MAX_RANGE_BITS, max(2, ceil(log2(max(1, text_bytes / RANGE_BYTES)))))


def cut(keys: np.ndarray, key_bits: int, bits: int) -> list[tuple[int, np.ndarray]]:
    """Sorted keys by range."""
    edges = np.arange((1 << bits) + 1, dtype=np.uint64) << np.uint64(key_bits - bits)
    at = np.searchsorted(keys, edges[:-1])
    at = np.append(at, len(keys))
    return [(r, keys[at[r]:at[r + 1]]) for r in range(1 << bits) if at[r + 1] > at[r]]


def blobs(keys: np.ndarray, key_bits: int, bits: int) -> list[tuple[int, bytes]]:
    return [(r, pack_sorted(part)) for r, part in cut(keys, key_bits, bits)]


def counted(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their counts over all blobs of a range."""
    keys = np.sort(np.concatenate([unpack_sorted(p) for p in packed])) if packed else np.zeros(0, np.uint64)
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.diff(np.append(starts, len(keys)))
